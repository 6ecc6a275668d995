"""The k best of each query, kept over all Arrow batches of a task, so a task hands on about k rows for each query.

Queries are numbers here. Rows that could still be among the k best for any other task's rows stay: with ``slack`` also
those so little below the k-th that both may be rounded alike, of equal scores those of the k smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are held before those that can't be among the best go.
HELD = 1 << 20


class Best:
    def __init__(self, queries: int, k: int, least: float, slack: np.ndarray | None = None):
        """``least``: no score below it counts."""
        self.k, self.slack = k, np.zeros(queries) if slack is None else slack
        self.floors = np.full(queries, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.rows, self.limit = 0, HELD

    def reach(self, query: int, scores: np.ndarray) -> float:
        """The least of ``scores``, all of one query, that can count."""
        n = len(scores) - self.k
        return self.floors[query] if n <= 0 else max(self.floors[query], np.partition(scores, n)[n] - self.slack[query])

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        self.parts.append((queries, scores, ids))
        self.rows += len(queries)
        if self.rows > self.limit:
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        queries, scores = (np.concatenate([p[c] for p in self.parts]) for c in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.parts])
        table = pa.table({"q": queries, "s": scores, "i": ids})
        order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("s", "descending"), ("i", "ascending")], null_placement="at_start").to_numpy()
        queries, scores = queries[order], scores[order]
        at = np.arange(len(order))
        starts = np.flatnonzero(np.diff(queries, prepend=-1))
        nth = at - np.repeat(starts, np.diff(starts, append=len(order)))
        kth = np.flatnonzero(nth == self.k - 1)
        self.floors[queries[kth]] = np.maximum(self.floors[queries[kth]], scores[kth] - self.slack[queries[kth]])
        equal = np.flatnonzero((nth == 0) | (np.diff(scores, prepend=np.inf) != 0))
        among = at - np.repeat(equal, np.diff(equal, append=len(order)))  # place among equal scores
        keep = (nth < self.k) | ((self.slack[queries] > 0) & (scores >= self.floors[queries]) & (among < self.k))
        self.parts = [(queries[keep], scores[keep], ids.take(pa.array(order[keep])))]
        self.rows = int(keep.sum())
        self.limit = self.rows + HELD

    def out(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        self.shrink()
        return self.parts[0] if self.parts else None
