"""Connected components of an undirected edge table by alternating large-star and small-star steps.

Every round is two grouped minima with their joins; nothing is collected but two sums per round. Hubs are safe: a
minimum is combined before the shuffle, and the joins on a hub's key are ones that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.session import cut


def _star(pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Link v of every row (u, v) of ``pairs`` to the least node among u and u's neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the least node of the component."""
    state = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    size = _size(state)
    while size[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both.filter("v > u"), both).distinct()
        small = _star(large, large).unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        state = cut(small.filter("u <> v").distinct())
        before, size = size, _size(state)
        if size == before:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
