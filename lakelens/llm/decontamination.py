"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item's window in a document has as many SHINGLE_WORDS-word shingles as the item (all of the document's, if it is
shorter). Similarity is the weighted Jaccard of the two shingle multisets; at SIMILARITY or more a document is
contaminated by the item. DataFrame functions only:

1. Windows. Items of one size share their windows. A window of similar content shares shingles, and sliding it right to
   its next shared shingle loses none, so windows of a size that begin at a shingle of any item of that size, and hold
   enough of such shingles, hold all similar passages; which item they are like is left open. The items' shingles are
   broadcast while their rows and bytes are few (BROADCAST_ROWS, BROADCAST_BYTES).
2. Search. Windows and items get 64-bit SimHashes of their words. Seven blocks of the items' fingerprints are indexed with
   all values up to two bits away, so that all fingerprints of one size within RADIUS = 7 * 3 - 1 = 20 bits meet in a
   block. Only this index proposes pairs of a window and an item.
3. Pairs are held to the radius, then verified exactly on the shingles' texts.

Words are runs of letters and digits, lower-cased; punctuation and case do not hide a passage.

Defined results: null or empty texts and texts or items of under SHINGLE_WORDS words match nothing; texts of any length
are searched whole; repeated documents give one row for each (doc_id, item_id), that of the best window, of equally good
ones the first; null ids are kept as null; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import keeps_columns, read_documents
from lakelens.session import cut

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCKS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))
FLIPS = 2
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
#: Rows and bytes that may be broadcast; beyond either the same joins run as shuffle joins.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    def body(w: Column) -> Column:
        n = F.size(w) - (SHINGLE_WORDS - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE_WORDS)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, body)


def shingle_texts(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE_WORDS - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE_WORDS), " "))


def simhash(words: Column) -> Column:
    """64-bit majority of the bits of the words' hashes, repeats included."""

    def body(hashes: Column) -> Column:
        ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(1).cast("int")))
        bits = F.transform(ones, lambda n, b: F.when(n * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return let(F.transform(words, lambda w: F.xxhash64(w)), body)


def block_values(fp: str) -> Column:
    """(block, value) of each of the fingerprint's blocks."""
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(fp), at).bitwiseAND((1 << width) - 1).alias("value")) for k, (at, width) in enumerate(BLOCKS)))


def near_values(block: tuple[int, int]) -> list[int]:
    """Masks of at most FLIPS bits of a block."""
    width = block[1]
    return [0, *(1 << i for i in range(width)), *(1 << i | 1 << j for i in range(width) for j in range(i))]


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of lesser over sum of greater multiplicities of two arrays of shingles."""


    def body(pair: Column) -> Column:
        count = lambda x, of: F.size(F.filter(of, lambda y: y == x))
        both = F.aggregate(F.array_intersect(pair["a"], pair["b"]), F.lit(0), lambda n, x: n + F.least(count(x, pair["a"]), count(x, pair["b"])))
        return let(both, lambda n: n / (F.size(pair["a"]) + F.size(pair["b"]) - n))

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, m (shingles) and fp of the items that have shingles, one row for each different (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("item_words")).distinct()
    items = items.filter(F.size("item_words") >= SHINGLE_WORDS).withColumn("item_key", F.xxhash64("item_id", "item_words"))
    return cut(items.select("item_key", "item_id", "item_words", (F.size("item_words") - (SHINGLE_WORDS - 1)).alias("m"), simhash(F.col("item_words")).alias("item_fp")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, item_id, window_start, window_words, distance and similarity of the best window of each match.

    ``th`` is a hash of the text, so that (doc_id, th) names a document even where doc_id is null or repeated.
    """
    items = prepared_items(benchmark)
    shingles = items.select("m", F.explode(shingle_hashes(F.col("item_words"))).alias("h")).distinct()
    n_items, n_shingles, n_bytes = (x or 0 for x in items.agg(F.count("*"), F.sum("m"), F.sum(F.octet_length(F.array_join("item_words", " ")))).first())
    as_is = lambda df: df
    hint = F.broadcast if n_shingles <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES else as_is

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = text.select("doc_id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    hashed = keyed.select("doc_id", "th", shingle_hashes(F.col("words")).alias("hashes"))
    places = hashed.select("doc_id", "th", F.size("hashes").alias("n"), F.posexplode("hashes").alias("at", "h"))
    hits = places.join(hint(shingles), "h").groupBy("doc_id", "th", "n", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))

    # windows of enough shared shingles: the ``need``-th shared one from the start lies inside
    held = F.least("m", "n")
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("m") + held) - 1e-9).cast("int")
    starts = F.filter(F.transform("at", lambda p, i: F.when(F.get("at", i + F.col("need") - 1) < p + F.col("held"), F.least(p, F.col("n") - F.col("held")))), lambda p: p.isNotNull())
    windows = hits.select("*", held.alias("held"), need.alias("need")).filter(F.size("at") >= F.col("need"))
    windows = cut(windows.select("doc_id", "th", "m", "held", F.array_distinct(starts).alias("starts")).filter(F.size("starts") > 0))
    found, n_starts = (x or 0 for x in windows.agg(F.count("*"), F.sum(F.size("starts"))).first())

    # the texts of documents with windows, by a second, pruned read
    by_doc = windows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("m", "held", "starts")).alias("windows"))
    by_doc = by_doc.select(F.col("doc_id").alias("k"), F.col("th").alias("k_th"), "windows")
    by_doc = F.broadcast(by_doc) if found * 8 + n_starts <= BROADCAST_ROWS // 2 else by_doc
    again = text.select("doc_id", "text", F.xxhash64("text").alias("th")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("k_th")))
    again = again.select("doc_id", "th", words_of(F.col("text")).alias("words"), F.explode("windows").alias("w")).select("doc_id", "th", "words", "w.*")
    window = F.slice(F.col("words"), F.col("start") + 1, F.col("held") + (SHINGLE_WORDS - 1))
    cut_out = again.withColumn("start", F.explode("starts")).select("doc_id", "th", "m", "start", window.alias("window"))
    printed = cut(cut_out.distinct().withColumn("fp", simhash(F.col("window"))))

    # multi-index blocks: the items' fingerprints under every change of at most FLIPS bits of a block
    changes = [near_values(b) for b in BLOCKS]
    flips = F.array(*(F.array(*(F.lit(v).cast("long") for v in c)) for c in changes))
    index = items.select("item_key", "m", "item_fp", F.explode(block_values("item_fp")).alias("b"))
    index = index.select("item_key", "m", "item_fp", F.col("b.block").alias("block"), F.explode(F.transform(flips[F.col("b.block")], lambda v: v.bitwiseXOR(F.col("b.value")))).alias("value"))
    index = F.broadcast(index) if n_items * sum(map(len, changes)) <= BROADCAST_ROWS // 2 else index
    met = printed.select("doc_id", "th", "m", "start", "fp", F.explode(block_values("fp")).alias("b")).select("doc_id", "th", "m", "start", "fp", "b.*").join(index, ["m", "block", "value"])
    met = met.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int")).filter(F.col("distance") <= RADIUS)
    met = met.select("doc_id", "th", "m", "start", "item_key", "distance").distinct().join(hint(items.select("item_key", "item_id", "item_words")), "item_key")
    met = met.select(F.col("doc_id").alias("k"), F.col("th").alias("k_th"), F.col("m").alias("k_m"), F.col("start").alias("k_start"), "item_id", "item_words", "distance")
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("k_th")) & (F.col("m") == F.col("k_m")) & (F.col("start") == F.col("k_start"))
    verified = printed.join(met, same).withColumn("similarity", weighted_jaccard(shingle_texts(F.col("window")), shingle_texts(F.col("item_words")))).filter(F.col("similarity") >= SIMILARITY)
    best = verified.groupBy("doc_id", "th", "item_id").agg(F.max_by(F.struct("start", F.size("window").alias("n"), "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("doc_id", "th", "item_id", F.col("best.start").cast("long").alias("window_start"), F.col("best.n").cast("long").alias("window_words"), F.col("best.distance").alias("distance"), F.round("best.similarity", 6).alias("similarity"))


@keeps_columns
def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th")).distinct()
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__bad_id")) & (th == F.col("__bad_th")), "left_anti")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_documents(spark, sf_dir), read_benchmark(spark, sf_dir))
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("window_start", "window_words", "distance", "similarity"), F.struct("similarity", -F.col("window_start"))).alias("b")).select("doc_id", "item_id", "b.*")
