"""Embeddings by content: a model is asked once for each different text, in batches, and never again (RK2, GL2).

The store is a table (content_hash, embedding) that grows by commits. Texts are reduced to distinct hashes, those that the
store has are left out by an anti-join, and only the rest go to the model, ``batch`` texts at a time; then the vectors are
joined back to all rows. The hash is SHA-256 of the text, so equal contents share a vector whatever their ids.

Defined results: a null text is the empty text; repeated rows get equal vectors; a write that was lost is not there, so
its texts are asked for again; an empty table asks for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.session import cut
from lakelens.sources.commits import Commits

BATCH = 64
Model = Callable[[list[str]], list[list[float]]]


class EmbeddingStore:
    def __init__(self, spark: SparkSession, folder: str, model: Model, batch: int = BATCH):
        self.spark, self.model, self.batch, self.log = spark, model, batch, Commits(spark, folder)

    def stored(self) -> DataFrame:
        commits = self.log.all()
        if not commits:
            return self.spark.createDataFrame([], "content_hash string, embedding array<double>")
        return self.log.read("vectors", commits).select("content_hash", "embedding")

    def embed(self, rows: DataFrame, column: str = "content") -> DataFrame:
        """``rows`` with ``embedding``; texts that are new to the store are embedded and stored first."""
        content = F.coalesce(F.col(column), F.lit(""))
        self.learn(rows.select(T.checksum(content).alias("content_hash"), content.alias("content")))
        return rows.withColumn("content_hash", T.checksum(content)).join(self.stored(), "content_hash", "left").drop("content_hash")

    def learn(self, texts: DataFrame) -> int:
        """Embeds the (content_hash, content) rows that the store lacks; how many different ones there were."""
        missing = cut(texts.join(self.stored().select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content")))
        n = missing.count()
        if n:
            number = self.log.begin("vectors")
            self._asked(missing).write.parquet(self.log.path("vectors", number))
            totals = missing.agg(F.count("*").alias("n_docs")).select("n_docs", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("n_gone"))
            self.log.finish(number, totals)
        return n

    def _asked(self, missing: DataFrame) -> DataFrame:
        model, size = self.model, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    part = batch.slice(start, size)
                    vectors = model(part.column(1).to_pylist())
                    if len(vectors) != part.num_rows:
                        raise ValueError(f"the model gave {len(vectors)} vectors for {part.num_rows} texts")
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["content_hash", "embedding"])

        return missing.select("content_hash", "content").mapInArrow(run, "content_hash string, embedding array<double>")
