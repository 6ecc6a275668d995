"""Tables that grow by numbered commits: a commit is a folder ``commit=<n>`` in each table, whole once ``commits`` has it.

Rows with an id that a later commit names in ``gone`` are dead. Nothing that is written is changed; a merge writes what
lives as one commit that replaces the earlier ones.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators import retrieve as R
from lakelens.sources.files import exists

COMMIT = "n_docs long, length long, n_gone long, replaces int"


class Commit(NamedTuple):
    """Changes of the number of rows and of their summed length, ids that die, and the last commit that this one replaces."""

    number: int
    n_docs: int
    length: int
    n_gone: int
    replaces: int


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def all(self) -> list[Commit]:
        """Those that count: from the newest merge on. A row for each write since then."""
        if not exists(self.spark, f"{self.folder}/commits"):
            return []
        rows = self.spark.read.schema(f"{COMMIT}, commit int").parquet(f"{self.folder}/commits").collect()
        found = sorted(Commit(r["commit"], r["n_docs"], r["length"], r["n_gone"], r["replaces"]) for r in rows)
        merged = max((c.replaces for c in found), default=-1)
        return [c for c in found if c.number > merged]

    def begin(self, table: str) -> int:
        """A number above all that were ever begun in ``table``, a commit's first one: what a lost write left is never read."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max((int(n.removeprefix("commit=")) for n in names if n.startswith("commit=")), default=-1) + 1

    def path(self, table: str, number: int) -> str:
        return f"{self.folder}/{table}/commit={number}"

    def finish(self, number: int, totals: DataFrame, replaces: int = -1) -> int:
        """``totals``: one row of n_docs, length and n_gone."""
        totals.withColumn("replaces", F.lit(replaces)).coalesce(1).write.parquet(self.path("commits", number))
        return number

    def read(self, table: str, commits: list[Commit]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*(self.path(table, c.number) for c in commits))

    def living(self, rows: DataFrame, commits: list[Commit]) -> DataFrame:
        """``rows`` (chunk_id, commit, ...) without dead ones; a commit's own ``gone`` only touches earlier ones."""
        if not any(c.n_gone for c in commits):
            return rows
        gone = self.read("gone", commits).groupBy("chunk_id").agg(F.max("commit").alias("until")).withColumnRenamed("chunk_id", "gone_id")
        return rows.join(R.small(gone), F.col("chunk_id").eqNullSafe(F.col("gone_id")) & (F.col("commit") < F.col("until")), "left_anti")

    def with_ids(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """``rows`` whose chunk_id is among ``ids``; null is an id like others."""
        return rows.join(ids.select(F.col("chunk_id").alias("gone_id")).distinct(), F.col("chunk_id").eqNullSafe(F.col("gone_id")), "left_semi")
