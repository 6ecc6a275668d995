"""One small local session for all tests; workers find the package by PYTHONPATH."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lakelens.session import build_session

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    session = build_session("local[8]", "tests", **conf)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
