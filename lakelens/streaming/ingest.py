"""Incremental ingestion (ST4): new documents are those whose checksum no stored document has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.operators.chunking import chunk_documents, dedup_documents, distinct_documents, without_known
from lakelens.session import cut
from lakelens.sources import files
from lakelens.sources import store as tables


def prepare(docs: DataFrame) -> DataFrame:
    """document_id, content, checksum (+ other columns) with sanitized content."""
    clean = docs.withColumn("content", T.sanitize(F.col("content")))
    return clean.withColumn("checksum", T.checksum(F.col("content")))


def name_of(docs: DataFrame) -> str:
    """A name that the same documents always have."""
    total = docs.agg(F.sum(F.xxhash64("document_id", "checksum").cast("decimal(38,0)")).alias("t"), F.count("*").alias("n")).first()
    return f"d{total['n']}x{int(total['t'] or 0):x}".replace("-", "m")


def ingest_batch(docs: DataFrame, store: str, batch: str | None = None) -> None:
    """Add a batch's new documents and their chunks to the tables of ``store``; doing it again changes nothing.

    A batch is named by its documents if by nothing else, and writing it again replaces it in both tables, so a run that was
    lost between them is made good by the next. Stored documents that come with another content give way.
    """
    spark = docs.sparkSession
    docs = cut(distinct_documents(prepare(docs)))
    batch = batch or name_of(docs)
    fresh = dedup_documents(docs).filter("status = 'ingested'").drop("status", "original")
    if tables.has(spark, store, "documents"):
        known = tables.read(spark, store, "documents", without=batch)
        fresh = cut(without_known(fresh, known))
        if not known.join(fresh.select("document_id"), "document_id", "left_semi").isEmpty():
            for name in ("chunks", "documents"):
                tables.replace(files.delete_documents(tables.read(spark, store, name, without=batch), fresh), store, name)
    tables.append(chunk_documents(fresh.drop("checksum")), store, "chunks", batch)
    tables.append(fresh, store, "documents", batch)


def ingest_stream(docs: DataFrame, store: str, checkpoint: str):
    """A query that ingests a stream of documents batch by batch; a batch that comes again replaces itself."""
    add = lambda rows, number: ingest_batch(rows, store, f"s{number}")
    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
