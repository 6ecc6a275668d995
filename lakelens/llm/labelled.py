"""Bounded samples of labelled documents for fitting; labels of held-out documents are never read into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of text that a sample for fitting holds at most.
SAMPLE_BYTES = 64 << 20


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text and y of at most ``rows`` labelled documents of at most ``size`` bytes in all that are not held out.

    They are taken whole, in the order of a hash of doc_id, until either bound is met; a text of over an eighth of ``size``
    is passed over. A doc_id that ``labels`` repeats takes its largest label; labels other than 0 and 1 are left out; rows
    that repeat a doc_id with its text count once.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    wanted = wanted.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    wanted = wanted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")  # labels of other documents take no place
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` narrow rows, so safe to broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).join(F.broadcast(wanted), "doc_id")
    sizes = found.groupBy("doc_id", "th").agg(F.max(F.octet_length("text")).cast("long").alias("n")).filter(F.col("n") <= size // 8)
    sizes = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(rows)  # one narrow row for each text, as above
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0))
    chosen = sizes.select("doc_id", "th", upto.alias("upto")).filter(F.col("upto") <= size).select("doc_id", "th")
    taken = found.join(F.broadcast(chosen), ["doc_id", "th"])
    return taken.groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y")
