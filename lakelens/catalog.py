"""All registered queries of the engine and their SQL."""

from lakelens.queries import analytics, services, texts  # noqa: F401
from lakelens.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
