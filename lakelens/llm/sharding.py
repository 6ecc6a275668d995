"""Sharding by global byte-size prefix sums: contiguous shards of nearly equal bytes. DataFrame functions only.

The order is ascending doc_id (nulls first). Quantiles of doc_id give ranges of nearly equal row counts; the totals
of the ranges, summed in order, give each range the bytes and rows before it, and a running sum inside a range gives
them for each document. A document goes to the shard in whose equal share of all bytes its middle byte lies, so each
shard is within one document of its target. Only narrow rows (doc_id, size, checksum) are shuffled, never texts.

Defined results: null text has size 8 and checksum 0; repeated doc_ids and repeated rows each get a place, ordered by
(doc_id, checksum, size), equal rows being interchangeable; null doc_ids come first; an empty table gives no rows;
texts of any length are one size and checksum; extra columns are ignored. doc_id is taken to be near unique: rows that share one doc_id are summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import read_documents
from lakelens.session import cut

ROW_OVERHEAD = 8


def range_bounds(docs: DataFrame, n_ranges: int) -> list[int]:
    """Ascending, distinct cut points of doc_id; their number is at most n_ranges, whatever the size of the table."""
    shares = [i / n_ranges for i in range(1, n_ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n_ranges)).alias("q")).first()["q"] if shares else None
    return sorted(set(found or []))


def range_index(column: str, bounds: list[int]) -> Column:
    """How many of ``bounds`` lie below the column's value (0 for null): binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    array, value = F.lit(bounds).cast("array<bigint>"), F.col(column)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(array, low + step - 1) < value, low + step).otherwise(low))
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def shard_by_bytes(docs: DataFrame, n_shards: int, n_ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (columns doc_id and text)."""
    spark = docs.sparkSession
    n_ranges = n_ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, min(n_ranges, 2048))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    keyed = cut(keyed.select("*", range_index("doc_id", bounds).alias("part")))
    totals = keyed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(  # one row for each range: at most 2,049
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    running = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.select("*", F.sum("size").over(running).alias("upto"), F.count("*").over(running).alias("nth")).join(F.broadcast(totals), "part")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.col("all_bytes"))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read_documents(spark, sf_dir), 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL with the query's rows; crc32 from its table of 256 remainders, byte by byte.
OP4_SQL = """WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, octet_length(b) + 8 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[1 + xor(c & 255, x)])), 4294967295) AS text_crc32 FROM d, crc),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle, sum(size) OVER () AS total FROM e),
p AS (SELECT *, least(23, CAST(floor(middle * 24 / total) AS INTEGER)) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""
