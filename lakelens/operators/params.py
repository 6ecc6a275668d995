"""Validated parameters of requests (FL12) and the engine's defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Least and greatest value of each parameter.
BOUNDS = {
    "top_k": (1, 100), "candidate_k": (1, 200), "rrf_k": (1, 500), "dense_weight": (0.0, 1.0), "sparse_weight": (0.0, 1.0), "min_score": (-1.0, 1.0),
    "max_context_tokens": (100, 32_000), "max_rows": (1, 500), "num_variations": (1, 10), "max_iterations": (1, 20), "temperature": (0.0, 2.0),
}


class Bounded:
    """A dataclass whose fields must lie in BOUNDS; raises ValueError naming the field."""

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in BOUNDS and not BOUNDS[f.name][0] <= value <= BOUNDS[f.name][1]:
                raise ValueError(f"{f.name} must be between {BOUNDS[f.name][0]} and {BOUNDS[f.name][1]}, not {value}")


@dataclass(frozen=True)
class Search(Bounded):
    query: str
    top_k: int = 5
    candidate_k: int = 25
    min_score: float = 0.0
    fusion: str = "rrf"
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 0.5

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.query.strip():
            raise ValueError("query must not be empty")
        if self.fusion not in ("rrf", "linear"):
            raise ValueError(f"unknown fusion {self.fusion}")


@dataclass(frozen=True)
class Answer(Bounded):
    query: str
    top_k: int = 5
    min_score: float = 0.0
    max_context_tokens: int = 4000
    verify_grounding: bool = True


@dataclass(frozen=True)
class Transform(Bounded):
    query: str
    num_variations: int = 3


@dataclass(frozen=True)
class Agent(Bounded):
    query: str
    max_iterations: int = 6
    temperature: float = 0.1
