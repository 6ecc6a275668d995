"""A stored inverted index: texts are tokenized once, when they are added (SRC11, SNK2, SNK3, SNK4, RK10, RK11, TP1).

Each write is one commit, a number, with a folder ``commit=<n>`` in each of these tables:

* ``chunks``: chunk_id, dl, its different words joined by spaces and how often it has each; what a delete takes statistics back by.
* ``postings``: a row for each block of a term's entries (ids, tfs, dls) in a segment of chunks, strongest first, with the
  largest tf and the smallest dl of the block (tfs and dls as bytes, four for each entry), from which the most that any entry can score follows for any statistics.
  A task cuts the segments of the chunks that it reads and sorts each by term, so nothing is shuffled and a search reads
  only the pages of its terms.
* ``frequencies``: by how much document frequencies fall with the dead; those of the living are the sums of ``postings``' n.
  ``gone``: ids whose entries of earlier commits are dead.
* ``commits``, written last: changes of the number of chunks and of their length. A commit without it is not there.

A search takes the segments one after another in each task. The first blocks of each query term, and the segments before,
give every query a score that k chunks reach for certain; a block whose best entry could not lift a chunk there, even with
the best entries of the query's weaker terms, brings no candidate: a chunk with a stronger term is found by that one. Only
candidates are then scored, and a task hands on about k of them for each query. Queries of more than ``R.WEIGHT_ROWS``
terms, nested ids and more than GONE dead ids are joined instead. The rows are those of ``retrieve.bm25_search`` over the same chunks.

Defined results: an id that is added again replaces its text; within one write the last text in text order counts; null
ids and texts without words are kept as chunks without postings; deleting what is not there changes nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, MapType, StructType

from lakelens.functions import latin
from lakelens.functions import text as T
from lakelens.operators import retrieve as R
from lakelens.operators.best import Best
from lakelens.session import cut, spread
from lakelens.sources.commits import Commit, Commits

#: Entries of a block, and share of a query's best possible score by which two scores may differ and still round alike.
BLOCK = 128
ROUNDING = 1e-4
#: Entries whose blocks are cut together, and blocks that are handed on at a time.
SEGMENT, ROWS = 1 << 21, 1 << 14
#: Dead ids, and bytes of them, up to which they are sent to the workers.
GONE, GONE_BYTES = 1 << 20, 32 << 20


def contribution(tf: Column | str, dl: Column | str, average: float) -> Column:
    """Score of an entry without its term's weight; it grows with tf and falls with dl."""
    tf, dl = (F.col(c) if isinstance(c, str) else c for c in (tf, dl))
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / average))


def _counted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, words, tfs) of (chunk_id, content): each different token of a text and how often it has it.

    Latin texts are cut into tokens in the worker, a batch at a time. Of others the tokens go there as one string, since
    none has a space, nor does lower-casing look beyond one.
    """
    schema = StructType().add(chunks.schema["chunk_id"]).add("dl", "integer").add("words", "string").add("tfs", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = latin.tokens(batch.column(1))
            others = _split(batch.column(2))
            chunk, rows = np.repeat(np.arange(len(sizes)), sizes), pc.list_value_length(others).to_numpy()
            if len(rest := others.flatten()):
                sizes, chunk, found = sizes + rows, np.append(chunk, np.repeat(np.arange(len(rows)), rows)), pa.concat_arrays([found, rest])
            tokens = found.dictionary_encode()
            many = max(len(tokens.dictionary), 1)
            keys, times = np.unique(chunk * many + tokens.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * many).astype(np.int32))
            words = pa.ListArray.from_arrays(ends, tokens.dictionary.take(pa.array(keys % many)))
            tfs = pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pc.binary_join(words, " "), tfs], names=schema.names)

    other = chunks.select("chunk_id", "content", latin.is_other(F.col("content")).alias("other"))
    found = F.lower(F.array_join(T.found(F.col("content"), T.BM25_TOKEN), " "))
    return other.select("chunk_id", F.when(~F.col("other"), F.col("content")).alias("text"), F.when(F.col("other"), found).alias("t")).mapInArrow(run, schema)


def _split(texts: pa.Array) -> pa.ListArray:
    """Words of texts that are joined by spaces; of null and empty texts none."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    words = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.where(words, pc.list_value_length(lists).to_numpy(), 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), lists.filter(pa.array(words)).flatten())


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Ids and lengths of chunks, and the entries' chunks, terms and frequencies, of about ``size`` entries at a time."""
    held, entries = [], 0

    def joined():
        block = pa.concat_batches(held)
        words = _split(block.column(2))
        chunk = np.repeat(np.arange(block.num_rows), pc.list_value_length(words).to_numpy())
        return block.column(0), block.column(1).to_numpy(), chunk, words.flatten(), block.column(3).flatten().to_numpy()

    for batch in batches:
        held.append(batch)
        entries += len(batch.column(3).flatten())
        if entries >= size:
            yield joined()
            held, entries = [], 0
    if entries:
        yield joined()


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The blocks of ``values`` between ``ends`` as bytes, four for each: one value of a row, not one for each entry."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _unpacked(blocks: pa.Array) -> np.ndarray:
    """The values of all blocks, one after another."""
    at = np.frombuffer(blocks.buffers()[1], np.int32)[blocks.offset : blocks.offset + len(blocks) + 1]
    return np.frombuffer(blocks.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.int32)


def _strongest(term: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Order of entries by term, then by falling ``strength`` (0 to 1) as far as its bits go beside the others in one number."""
    bits, low = len(term).bit_length(), int(term.max(initial=0)).bit_length()
    free = min(63 - bits - low, 30)
    weak = ((1 - strength) * ((1 << free) - 1)).astype(np.int64)
    keys = (term.astype(np.int64) << free | weak) << bits | np.arange(len(term))
    keys.sort()
    return keys & ((1 << bits) - 1)


class Asks(NamedTuple):
    """Query ids and terms, each query's first and last pair with a term, the pairs' terms and weights, the average length and dead ids."""

    ids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    ends: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    slack: np.ndarray
    average: float
    gone: pa.Array | None
    until: np.ndarray | None


class Segment:
    """The blocks of one segment that hold terms of queries."""

    def __init__(self, asks: Asks, commit: int, blocks: pa.RecordBatch):
        term = pc.index_in(blocks.column("term"), value_set=asks.terms).to_numpy()
        order = np.lexsort((blocks.column("block").to_numpy(), term))
        blocks, term = blocks.take(pa.array(order)), term[order]
        lists = blocks.column("ids")
        sizes = pc.list_value_length(lists).to_numpy()
        ids = lists.flatten().dictionary_encode(null_encoding="encode")
        chunk, tf, dl = ids.indices.to_numpy(), _unpacked(blocks.column("tfs")), _unpacked(blocks.column("dls"))
        self.ids, self.postings = ids.dictionary, sizes
        if asks.gone is not None:
            named = pc.index_in(self.ids, value_set=asks.gone)
            dead = pc.is_valid(named).to_numpy(zero_copy_only=False) & (asks.until[pc.fill_null(named, 0).to_numpy()] > commit)
            lives = ~dead[chunk]
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[lives], minlength=len(sizes))
            chunk, tf, dl = chunk[lives], tf[lives], dl[lives]
        self.chunk, self.at = chunk, np.concatenate([[0], np.cumsum(sizes)])
        score = lambda tf, dl: tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / asks.average))
        self.part, self.bound = score(tf, dl), score(blocks.column("max_tf").to_numpy(), blocks.column("min_dl").to_numpy())
        self.first, self.last = (np.searchsorted(term, np.arange(len(asks.terms)), side=side) for side in ("left", "right"))

    def best(self, asks: Asks, query: int, k: int, heads: int, floor: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Candidates of a query that may have ``floor`` and be among its k best, their scores, and how many postings it has and scores."""
        pairs = [p for p in range(asks.starts[query], asks.ends[query]) if self.first[asks.term[p]] < self.last[asks.term[p]]]
        part, at = np.zeros(len(self.ids)), self.at
        terms = []
        for p in pairs:
            first, last, weight = self.first[asks.term[p]], self.last[asks.term[p]], asks.weight[p]
            s = slice(at[first], at[min(first + heads, last)])
            part[self.chunk[s]] += weight * self.part[s]
            bounds = weight * self.bound[first:last]
            terms.append((bounds.max(), first, last, weight, bounds))
        n = len(part) - k
        if n >= 0:
            floor = max(floor, np.partition(part, n)[n] - asks.slack[query])
        found, weaker = np.zeros(len(part), bool), 0.0
        for most, first, _, _, bounds in sorted(terms, key=lambda t: t[0]):
            # a chunk is found by the strongest of its terms, so a block needs its term's weaker ones alone
            for b in np.flatnonzero(bounds + weaker >= floor) + first:
                found[self.chunk[at[b] : at[b + 1]]] = True
            weaker += most
        raw, times = np.zeros(len(part)), np.zeros(len(part), np.int64)
        for _, first, last, weight, _ in terms:
            s = slice(at[first], at[last])
            raw[self.chunk[s]] += weight * self.part[s]
            times[self.chunk[s]] += 1
        hits = np.flatnonzero(found & (raw >= floor))
        return hits, raw[hits], int(sum(self.postings[first:last].sum() for _, first, last, _, _ in terms)), int(times[found].sum())


def _by_segment(asks: Asks, batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """Segments of batches that are sorted by commit and share."""

    def runs() -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        for batch in batches:
            commit, share = (batch.column(c).to_numpy() for c in ("commit", "share"))
            cuts = np.flatnonzero((np.diff(commit, prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0))
            for s, e in zip(cuts, np.append(cuts[1:], len(commit)), strict=True):
                yield (int(commit[s]), int(share[s])), batch.slice(s, e - s)

    for (commit, _), blocks in itertools.groupby(runs(), key=lambda r: r[0]):
        yield Segment(asks, commit, pa.concat_batches([b for _, b in blocks]))


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, block: int = BLOCK, segment: int = SEGMENT):
        self.spark, self.block, self.segment, self.log = spark, block, segment, Commits(spark, folder)

    def _commit(self, chunks: DataFrame, gone: DataFrame | None, replaces: int = -1, earlier: list[Commit] | None = None) -> int:
        """Writes one commit of ``chunks`` (chunk_id, dl, words, tfs) that kills the ids ``gone`` of the ``earlier`` ones."""
        number = self.log.begin("chunks")
        out = lambda table: self.log.path(table, number)
        chunks.write.parquet(out("chunks"))
        chunks = self.spark.read.parquet(out("chunks"))
        self._blocks(chunks).write.option("compression", "zstd").parquet(out("postings"))
        dead = None
        if gone is not None and earlier:
            stored = self.log.read("chunks", earlier)
            dead = cut(self.log.with_ids(self.log.living(stored.select("chunk_id", "commit", "dl"), earlier), gone))
            named = R.small(dead.select(F.col("chunk_id").alias("dead_id"), F.col("commit").alias("of")), GONE, GONE_BYTES)
            taken = stored.join(named, F.col("chunk_id").eqNullSafe(F.col("dead_id")) & (F.col("commit") == F.col("of")), "left_semi")
            self._fewer(taken).write.parquet(out("frequencies"))
        (chunks if dead is None else dead).select("chunk_id").filter(F.lit(dead is not None)).write.parquet(out("gone"))
        sums = [F.count("*").alias("n"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)).alias("length")]
        totals = chunks.agg(*sums).select("n", "length", F.lit(0).cast("long").alias("n_gone"))
        if dead is not None:
            totals = totals.unionByName(dead.agg(*sums).select((-F.col("n")).alias("n"), (-F.col("length")).alias("length"), F.col("n").alias("n_gone")))
        totals = totals.agg(F.sum("n").alias("n_docs"), F.sum("length").alias("length"), F.sum("n_gone").alias("n_gone"))
        return self.log.finish(number, totals, replaces)

    def _blocks(self, chunks: DataFrame) -> DataFrame:
        """Blocks of each term, cut in the task that reads the chunks: each segment of chunks is a share of its own.

        Order within a share is by tf / dl, which ranks entries alike for most statistics; bounds are right for all.
        """
        kind, size, segment = chunks.schema["chunk_id"].dataType, self.block, self.segment
        schema = StructType().add("term", "string").add("share", "long").add("block", "integer").add("max_tf", "integer").add("min_dl", "integer").add("n", "long")
        schema = schema.add("ids", ArrayType(kind)).add("tfs", BinaryType()).add("dls", BinaryType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            share = TaskContext.get().partitionId() << 20
            for ids, dl, chunk, terms, tf in _segments(batches, segment):
                words = terms.dictionary_encode()
                order = pc.sort_indices(words.dictionary)
                place = np.empty(len(order), np.int32)
                place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
                at = _strongest(place[words.indices.to_numpy()], tf / (tf + np.maximum(dl[chunk], 1) / 256.0))
                term, tf, length = place[words.indices.to_numpy()[at]], tf[at], dl[chunk[at]]
                nth = np.arange(len(at)) - np.repeat(starts := np.flatnonzero(np.diff(term, prepend=-1)), np.diff(starts, append=len(at)))
                cuts = np.flatnonzero(nth % size == 0)
                ends = pa.array(np.append(cuts, len(at)).astype(np.int32))
                columns = [
                    words.dictionary.take(order).take(pa.array(term[cuts])),
                    pa.array(np.full(len(cuts), share)),
                    pa.array((nth[cuts] // size).astype(np.int32)),
                    pa.array(np.maximum.reduceat(tf, cuts)),
                    pa.array(np.minimum.reduceat(length, cuts)),
                    pa.array(np.diff(cuts, append=len(at))),
                    pa.ListArray.from_arrays(ends, ids.take(pa.array(chunk[at]))),
                    *(_packed(values, np.append(cuts, len(at))) for values in (tf, length)),
                ]
                blocks, share = pa.RecordBatch.from_arrays(columns, names=schema.names), share + 1
                yield from (blocks.slice(i, ROWS) for i in range(0, blocks.num_rows, ROWS))

        return chunks.select("chunk_id", "dl", "words", "tfs").mapInArrow(run, schema)

    def _fewer(self, chunks: DataFrame) -> DataFrame:
        """(term, df): by how many of ``chunks`` a term is in fewer texts; a row for each term and segment, as in postings."""
        segment = self.segment

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, terms, _ in _segments(batches, segment):
                counts = terms.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), pc.negate(counts.field("counts"))], names=["term", "df"])

        return chunks.select("chunk_id", "dl", "words", "tfs").mapInArrow(run, "term string, df long")

    def _frequencies(self, commits: list[Commit]) -> DataFrame:
        """(term, df): parts whose sum over a term's rows is its document frequency."""
        parts = self.log.read("postings", commits).select("term", F.col("n").alias("df"))
        changed = [c for c in commits if c.n_gone]
        return parts.unionByName(self.log.read("frequencies", changed).select("term", "df")) if changed else parts

    # writes

    def add(self, chunks: DataFrame) -> int:
        """Indexes (chunk_id, content); ids that are there already are replaced. The commit's number."""
        commits = self.log.all()
        return self._commit(_counted(spread(self._last(chunks.select("chunk_id", "content")))), chunks.select("chunk_id"), earlier=commits)

    def _last(self, chunks: DataFrame) -> DataFrame:
        """The last text of each id. Only texts of ids that come more than once are shuffled."""
        repeated = cut(chunks.groupBy("chunk_id").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("chunk_id").alias("repeated_id")))
        if repeated.isEmpty():
            return chunks
        repeated = R.small(repeated)
        same = F.col("chunk_id").eqNullSafe(F.col("repeated_id"))
        last = chunks.join(repeated, same, "left_semi").groupBy("chunk_id").agg(F.max("content").alias("content"))
        return chunks.join(repeated, same, "left_anti").unionByName(last)

    def delete(self, ids: DataFrame) -> int:
        """Takes the chunks of ``ids`` (chunk_id) out of all results and statistics; stored texts are not tokenized again."""
        commits = self.log.all()
        if not commits:
            raise ValueError("the index is empty")
        return self._commit(self.log.read("chunks", commits[:1]).filter("false").drop("commit"), ids, earlier=commits)

    def merge(self) -> int:
        """One commit of what lives; earlier ones stay on disk but no longer count."""
        commits = self.log.all()
        return self._commit(self.log.living(self.log.read("chunks", commits), commits).drop("commit"), None, replaces=commits[-1].number)

    # search

    def statistics(self) -> tuple[int, float]:
        """Number of chunks and their average length."""
        commits = self.log.all()
        n, length = sum(c.n_docs for c in commits), sum(c.length for c in commits)
        return n, length / n if n else 1.0

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, weight) of the query terms that the index has."""
        n, _ = self.statistics()
        wanted = R.query_terms(queries)
        df = R.small(self._frequencies(self.log.all()).join(R.small(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return wanted.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best of each of ``queries`` (query_id, query)."""
        asks = self._asks(queries)
        if asks is None:
            scored, _ = self._scored(queries, k)
            scored = R.over_best(scored.filter("raw > 0"), queries)
        else:
            best = F.max("raw").over(Window.partitionBy("query_id"))  # of about k rows from each task
            scored = self._best(asks, k).withColumn("score", F.round(F.col("raw") / best, 4))
        return R.top_k(scored.select("query_id", "chunk_id", "score"), k, F.desc("score"), F.asc("chunk_id"))

    def report(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """For each query its number of postings and how many of them a search for the k best scores."""
        asks = self._asks(queries)
        if asks is not None:
            return self._best(asks, k, counts=True).groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored"))
        scored, blocks = self._scored(queries, k)
        all_ = blocks.groupBy("query_id").agg(F.sum("n").alias("postings"))
        return all_.join(scored.groupBy("query_id").agg(F.sum("n").alias("scored")), "query_id", "left").select("query_id", "postings", F.coalesce("scored", F.lit(0)).alias("scored"))

    def _with_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """``rows`` of the given terms; up to LITERAL_TERMS reach the scan, which then reads the pages that hold them."""
        if len(terms) <= R.LITERAL_TERMS:
            return rows.filter(F.col("term").isin(terms))
        wanted = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        return rows.join(R.small(wanted), "term", "left_semi")

    def _asks(self, queries: DataFrame) -> Asks | None:
        """What the workers need of the queries and of the dead ids, if both are few; a bounded look."""
        commits, (n, average) = self.log.all(), self.statistics()
        if not commits:
            raise ValueError("the index is empty")
        given = R.asked(queries)
        stored = self.log.read("chunks", commits).schema["chunk_id"].dataType
        if given is None or isinstance(stored, ArrayType | MapType | StructType):
            return None
        gone = until = None
        if any(c.n_gone for c in commits):
            dead = self.log.read("gone", commits).groupBy("chunk_id").agg(F.max("commit").alias("until"))
            seen = dead.limit(GONE + 1).agg(F.count("*"), F.sum(R.row_bytes(dead).cast("long"))).first()
            if seen[0] > GONE or seen[1] > GONE_BYTES:
                return None
            found = dead.toArrow().combine_chunks()
            gone, until = (found.column(c).combine_chunks() for c in ("chunk_id", "until"))
            until = until.to_numpy()
        terms = given.terms.to_pylist()
        counted = self._with_terms(self._frequencies(commits), terms).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").toArrow()
        df = np.zeros(len(terms))
        df[pc.index_in(counted.column("term"), value_set=given.terms).to_numpy()] = counted.column("df").to_numpy()
        order = np.lexsort((given.term, given.query))
        order = order[df[given.term[order]] > 0]
        query, term = given.query[order], given.term[order]
        weight = given.times[order] * np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
        starts, ends = (np.searchsorted(query, np.arange(len(given.ids)), side=side) for side in ("left", "right"))
        slack = R.ROUNDING * (R.K1 + 1) * np.bincount(query, weight, len(given.ids))
        return Asks(given.ids, given.terms, starts, ends, term, weight, slack, average, gone, until)

    def _best(self, asks: Asks, k: int, counts: bool = False) -> DataFrame:
        """(query_id, chunk_id, raw) of the candidates that may be among the k best of a query; with ``counts`` (query_id, postings, scored)."""
        commits, heads, context = self.log.all(), -(-k // self.block) + 1, self.spark.sparkContext
        rows = self._with_terms(self.log.read("postings", commits), asks.terms.to_pylist()).drop("n")
        # every task hands on up to k rows for each query, so there are no more tasks than keep the cores busy
        rows = rows.repartition(2 * context.defaultParallelism, "commit", "share").sortWithinPartitions("commit", "share")
        kind = self.log.read("chunks", commits).schema["chunk_id"].dataType
        table, id_type = context.broadcast(asks), to_arrow_type(kind)
        schema = StructType().add("query_id", from_arrow_type(asks.ids.type))
        schema = schema.add("postings", "long").add("scored", "long") if counts else schema.add("chunk_id", kind).add("raw", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks = table.value
            queries = np.flatnonzero(asks.starts < asks.ends)
            best, seen = Best(len(asks.ids), k, np.nextafter(0, 1), asks.slack), np.zeros((2, len(asks.ids)), np.int64)
            for segment in _by_segment(asks, batches):
                of, at, scores = [], [], []
                for query in queries:
                    hits, raw, *numbers = segment.best(asks, query, k, heads, best.floors[query])
                    seen[:, query] += numbers
                    of.append(np.full(len(hits), query, np.int32))
                    at.append(hits)
                    scores.append(raw)
                best.add(np.concatenate(of), np.concatenate(scores), segment.ids.take(pa.array(np.concatenate(at))))
                best.shrink()
            if counts:
                columns = queries, [pa.array(x[queries]) for x in seen]
            elif (kept := best.out()) is not None:
                columns = kept[0], [kept[2].cast(id_type), pa.array(kept[1])]
            else:
                return
            yield pa.RecordBatch.from_arrays([asks.ids.take(pa.array(columns[0])), *columns[1]], names=schema.names)

        return rows.mapInArrow(run, schema)

    def _scored(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Raw scores of each query's candidates, with the number of entries; the bounded blocks of each query. By joins."""
        commits, (_, average) = self.log.all(), self.statistics()
        hint = F.broadcast if R.fits(queries, 64) else (lambda df: df)
        weights = cut(self.weights(queries))
        terms = [r["term"] for r in weights.select("term").distinct().limit(R.LITERAL_TERMS + 1).collect()]
        postings = self.log.read("postings", commits)
        few = len(terms) <= R.LITERAL_TERMS
        # literal terms reach the scan, which then reads the row groups that hold them
        postings = cut(postings.filter(F.col("term").isin(terms)) if few else postings.join(hint(weights.select("term").distinct()), "term", "left_semi"))
        bounds = postings.select("term", "commit", "share", "block", "n", contribution("max_tf", "min_dl", average).alias("bound"))
        bounded = cut(bounds.join(hint(weights), "term").withColumn("bound", F.col("bound") * F.col("weight")))
        sums = bounded.groupBy("query_id", "term").agg(F.max("bound").alias("most"), F.first("weight").alias("weight"))
        ceilings = sums.groupBy("query_id").agg(F.sum("most").alias("ceiling"))
        heads = self._entries(postings.filter(F.col("block") < -(-k // self.block) + 1), commits)
        partial = heads.join(hint(weights), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * contribution("tf", "dl", average)).alias("part"))
        kth = R.top_k(partial, k, F.desc("part"), F.asc("chunk_id")).filter(F.col("rank") == k).select("query_id", F.col("part").alias("floor"))
        floors = ceilings.join(hint(kth), "query_id", "left").select("query_id", "ceiling", (F.coalesce("floor", F.lit(0.0)) - F.col("ceiling") * ROUNDING).alias("floor"))
        # a chunk is found by the strongest of its terms, so a block needs its term's weaker ones alone
        weaker = F.coalesce(F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ranked = sums.select("query_id", "term", weaker.alias("weaker")).join(floors, "query_id")
        essential = bounded.join(hint(ranked), ["query_id", "term"]).filter(F.col("bound") + F.col("weaker") >= F.col("floor"))
        blocks = essential.select("query_id", "term", "commit", "share", "block")
        entries = self._entries(postings, commits)
        candidates = cut(entries.join(hint(blocks), ["term", "commit", "share", "block"]).select(F.col("query_id").alias("of"), F.col("chunk_id").alias("found")).distinct())
        exact = entries.select("term", "chunk_id", contribution("tf", "dl", average).alias("part")).join(hint(weights), "term").join(candidates, (F.col("query_id") == F.col("of")) & F.col("chunk_id").eqNullSafe(F.col("found")), "left_semi")
        return exact.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("part")).alias("raw"), F.count("*").alias("n")), bounded

    def _entries(self, postings: DataFrame, commits: list[Commit]) -> DataFrame:
        """Living entries of blocks."""
        names = ["term", "commit", "share", "block"]
        schema = StructType([*postings.select(names).schema, StructType().add("chunk_id", postings.schema["ids"].dataType.elementType)[0]]).add("tf", "integer").add("dl", "integer")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("ids")
                rows = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy()))
                columns = [*(batch.column(n).take(rows) for n in names), ids.flatten(), *(pa.array(_unpacked(batch.column(n))) for n in ("tfs", "dls"))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return self.log.living(postings.select(*names, "ids", "tfs", "dls").mapInArrow(run, schema), commits)
