"""A stored vector index: a coarse quantiser deals vectors to lists, and a search reads the lists near each query (SRC10, RK5, TP2).

Centroids are fitted by spherical k-means on at most TRAIN vectors, those of least hash, on the driver; every vector is
stored in the list of its nearest centroid, with what else its row has, and lists are sorted in files, so that a search
reads the row groups of the lists it probes. A frequent vector's list is dealt to several files. Filters apply inside lists.

A search probes the ``probes`` lists whose centroids are nearest to a query and scores their vectors exactly. With
``exact`` it goes on: no vector of a list can be nearer to a query than the angle to the list's centroid less the list's
greatest angle, so the lists that could still hold one of the k best are read as well, and the rows are those of
``retrieve.dense_search``.

Defined results: vectors without a direction (null, empty, of other lengths, zero, with null or non-finite entries) are in
a list of their own that is always read; an id that is added again replaces its vector; deleting what is not there changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakelens.operators import retrieve as R
from lakelens.session import cut
from lakelens.sources.commits import Commits

#: Vectors that centroids are fitted on at most, rounds of fitting, lists at most, and the list of vectors without direction.
TRAIN, ROUNDS, MOST_LISTS, ODD = 20_000, 12, 4096, -1
#: By how much rounded scores may hide a difference.
ROUNDING = 2e-6


def unit_rows(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have a direction."""
    out, good = np.zeros((len(vectors), dims)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims and None not in v:
            row = np.asarray(v, float)
            length = np.sqrt((row * row).sum())
            if np.isfinite(length) and length > 0:
                out[i], good[i] = row / length, True
    return out, good


def fit_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from spread-out starts; empty lists take the vectors that lie farthest from their centroids."""
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    rng = np.random.default_rng(0)
    centroids = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = vectors @ centroids.T
        nearest = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        lengths = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(lengths == 0)
        sums[empty] = vectors[np.argsort(near.max(axis=1))[: len(empty)]]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Commits(spark, folder)

    def build(self, vectors: DataFrame, lists: int | None = None, train: int = TRAIN) -> int:
        """Fits ``lists`` centroids (about the root of the number of vectors) and stores (chunk_id, embedding, ...)."""
        sizes = vectors.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).filter("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
        n, dims = (sizes["n"], sizes["dims"]) if sizes else (0, 0)
        sample = vectors.filter(F.size("embedding") == dims).select("embedding").orderBy(F.xxhash64("chunk_id"), F.xxhash64("embedding")).limit(train).toArrow()  # ``train`` rows
        unit, good = unit_rows(sample.column(0).to_pylist(), dims)
        centroids = fit_centroids(unit[good], lists or max(1, min(MOST_LISTS, round(n**0.5))))
        rows = self.spark.createDataFrame([(json.dumps(dims), i, c.tolist()) for i, c in enumerate(centroids)] or [(json.dumps(dims), ODD, [])], "dims string, list int, centroid array<double>")
        rows.coalesce(1).write.parquet(self.log.path("centroids", 0))
        return self.add(vectors)

    def centroids(self) -> tuple[int, np.ndarray]:
        """Dimensions and the centroids' matrix, MOST_LISTS rows at most."""
        rows = sorted(self.spark.read.parquet(self.log.path("centroids", 0)).collect(), key=lambda r: r["list"])
        dims = json.loads(rows[0]["dims"])
        found = [r["centroid"] for r in rows if r["list"] != ODD]
        return dims, np.array(found, float).reshape(len(found), dims)

    def add(self, vectors: DataFrame) -> int:
        """Stores vectors (each id once) in the lists of their nearest centroids; ids that are there are replaced."""
        earlier = self.log.all()
        number = self.log.begin("vectors")
        dims, centroids = self.centroids()
        columns = vectors.columns
        schema = StructType([*vectors.schema.fields]).add("list", "integer").add("angle", "double")
        at = columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, good = unit_rows(batch.column(at).to_pylist(), dims)
                good &= len(centroids) > 0
                near = unit @ centroids.T if len(centroids) else np.zeros((len(unit), 1))
                nearest = np.where(good, near.argmax(axis=1), ODD).astype(np.int32)
                angle = np.where(good, np.arccos(np.clip(near.max(axis=1), -1, 1)), np.pi)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(angle)], names=[*columns, "list", "angle"])

        # ranges of (list, hash): files hold neighbouring lists, and a large list several files
        placed = vectors.mapInArrow(run, schema).repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list")
        placed.write.parquet(self.log.path("vectors", number))
        placed = self.spark.read.parquet(self.log.path("vectors", number))
        placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).coalesce(1).write.parquet(self.log.path("lists", number))
        return self._finish(number, placed, vectors if earlier else None, earlier)

    def delete(self, ids: DataFrame) -> int:
        """Takes ``ids`` (chunk_id) out of all results."""
        earlier = self.log.all()
        number = self.log.begin("vectors")
        nothing = self.log.read("vectors", earlier[:1]).filter("false").drop("commit")
        nothing.write.parquet(self.log.path("vectors", number))
        nothing.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).write.parquet(self.log.path("lists", number))
        return self._finish(number, nothing, ids, earlier)

    def _finish(self, number: int, placed: DataFrame, gone: DataFrame | None, earlier: list) -> int:
        living = self.log.living(self.log.read("vectors", earlier), earlier).select("chunk_id") if earlier else placed.select("chunk_id").filter("false")
        dead = cut(self.log.with_ids(living, gone) if gone is not None else living.filter("false"))
        dead.write.parquet(self.log.path("gone", number))
        n_gone = dead.count()
        totals = placed.agg(F.count("*").alias("n")).select((F.col("n") - n_gone).alias("n_docs"), F.lit(0).cast("long").alias("length"), F.lit(n_gone).cast("long").alias("n_gone"))
        return self.log.finish(number, totals)

    def count(self) -> int:
        return sum(c.n_docs for c in self.log.all())

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, where: Column | None = None, min_score: float = 0.0) -> DataFrame:
        """query_id, chunk_id, score, rank of the k best found for each of ``queries`` (query_id, embedding).

        Queries are a stated set: blocks of them, of at most R.MATRIX_VALUES numbers, are sent to the tasks one after another.
        """
        commits = self.log.all()
        dims, centroids = self.centroids()
        per_block = max(1, R.MATRIX_VALUES // max(1, dims, len(centroids)))
        asked = queries.select("query_id", "embedding").toArrow()
        found = None
        for start in range(0, max(1, asked.num_rows), per_block):
            block = asked.slice(start, per_block)
            part = self._block(block.column(0).to_pylist(), block.column(1).to_pylist(), queries.schema["query_id"], commits, dims, centroids, k, probes, exact, where, min_score)
            found = part if found is None else found.unionByName(part)
        return R.top_k(found.filter(F.col("score") >= min_score) if min_score > 0 else found, k, F.desc("score"), F.asc("chunk_id"))

    def _block(self, ids: list, vectors: list, id_field, commits: list, dims: int, centroids: np.ndarray, k: int, probes: int, exact: bool, where: Column | None, min_score: float) -> DataFrame:
        unit, good = unit_rows(vectors, dims)
        near = unit @ centroids.T
        order = np.argsort(-near, axis=1, kind="stable")
        wanted = np.zeros(near.shape, bool)
        np.put_along_axis(wanted, order[:, :probes], True, axis=1)
        wanted[~good] = exact  # a query without direction is as near to all vectors: 0
        first = self._scores(ids, vectors, id_field, wanted, commits, k, where, min_score)
        if not exact or not len(centroids):
            return first
        first = cut(first)
        kth = {r["query_id"]: r["score"] for r in R.top_k(first, k, F.desc("score"), F.asc("chunk_id")).filter(F.col("rank") == k).select("query_id", "score").collect()}  # a row for each query of the block
        radius = np.full(len(centroids), -1.0)
        for r in self.log.read("lists", commits).filter(F.col("list") != ODD).groupBy("list").agg(F.max("radius").alias("radius")).collect():
            radius[r["list"]] = r["radius"]
        best = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius - 1e-7))
        floors = np.array([kth.get(i, -2.0) for i in ids])
        more = (best + ROUNDING >= floors[:, None]) & (radius >= 0) & ~wanted
        return first.unionByName(self._scores(ids, vectors, id_field, more, commits, k, where, min_score, odd=False)) if more.any() else first

    def _scores(self, ids: list, vectors: list, id_field, wanted: np.ndarray, commits: list, k: int, where: Column | None, min_score: float, odd: bool = True) -> DataFrame:
        """(query_id, chunk_id, score) of the k best of each batch for the queries that want its lists."""
        lists = [int(i) for i in np.flatnonzero(wanted.any(axis=0))] + [ODD] * odd
        rows = self.log.read("vectors", commits).filter(F.col("list").isin(lists))
        rows = self.log.living(rows if where is None else rows.filter(where), commits).select("chunk_id", "embedding", "list")
        schema = StructType().add("_q", "long").add(rows.schema["chunk_id"]).add("score", "double")
        askers = {i: np.flatnonzero(wanted[:, i]) if i != ODD else np.arange(len(ids)) for i in lists}
        matrices = [np.asarray([x if x is not None else np.nan for x in v], float) if v else np.zeros(0) for v in vectors]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = batch.column(2).to_numpy()
                for number in np.unique(of).tolist():
                    inside = batch.filter(pa.array(of == number))
                    for at, values in R._by_size(inside):
                        for size in {len(matrices[i]) for i in askers[number].tolist()}:
                            some = np.array([i for i in askers[number].tolist() if len(matrices[i]) == size])
                            block = np.array([matrices[i] for i in some]).reshape(len(some), size)
                            for i, keep, scores in R._best(block, values, k, min_score):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), some[i], np.int64)), inside.column(0).take(pa.array(at[keep])), pa.array(scores)], names=["_q", "chunk_id", "score"])

        number = self.spark.createDataFrame(list(enumerate(ids)), StructType().add("_q", "long").add("query_id", id_field.dataType))
        return rows.mapInArrow(run, schema).join(F.broadcast(number), "_q").drop("_q")  # a row for each query of the block
