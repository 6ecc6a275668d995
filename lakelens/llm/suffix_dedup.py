"""Suffix-array dedup: every byte covered by a LENGTH-byte string that also starts elsewhere is found and removed.

A family of suffix arrays of geometrically growing size (SuffixFamily) does the matching: the suffixes of a new batch are
sorted by their bytes, the sorted batch is merge-scanned against the array of every level for matches of LENGTH bytes,
and becomes a level; levels of about equal size merge. Bytes decide, hashes only route:

Each LENGTH-byte window is assigned the leftmost least hash of the 8-byte strings that begin in its first WINDOW
positions, its anchor; windows of one anchor are a run, and equal windows have anchors at the same place in them, followed
by the same CORE bytes. Runs go to the family of their core's hash, and suffixes are sorted by core and place of the
anchor first, then by bytes, so that only windows that can be equal are ever compared. A run whose core occurs once has no
equal windows and goes nowhere. Of runs whose whole context (all bytes that windows of the anchor can hold) is the same
by a hash of 128 bits, two are indexed and compared byte by byte; all further ones are repeated as those are.

A hot core, of more than HOT_CORE different contexts in all or HOT_BATCH runs in one batch of texts, is split further by
what groups of eight windows have in common, so that a passage that a third of all documents share is indexed by many
tasks. Of the contexts of a batch that repeat, and of a task's equal groups, only two leave the task. Runs of a core that is hot in their
batch are counted by parts of their contexts (salts), and a mark tells the runs of batches where it is not hot that it is.
There are more tasks the more runs there are (TASK_RUNS).

Texts are shuffled once, by document. Texts that have a copy are told by their digest and go whole; a task indexes one of
its copies, so a group of them is indexed at most once a task. No document pairs or all-pairs of a group are made.

Defined results: null or empty text has nothing to remove; repeated rows count as elsewhere, so texts of LENGTH bytes and
more that have a copy are removed whole; texts of any length are handled in pieces of PIECE bytes, as if whole; ties (equal
windows, equal hashes of 8 bytes) go to the leftmost and change no result; an empty table gives no rows; null doc_ids are
kept; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakelens.llm.common import arrow_schema, map_arrow, read_documents, text_bytes
from lakelens.session import cut

LENGTH = 200
WINDOW = 136
CORE = 64
GRAM = 8
GROUP = 8
HOT_CORE = 5000
HOT_BATCH = 16
SALTS = 16
BATCH_SUFFIXES = 1 << 17
BATCH_RUNS = 1 << 19
TASK_RUNS = 1 << 17
PIECE = 1 << 21
REMEMBERED_TEXTS = 200_000
REMEMBERED_GROUPS = 100_000
NO_ID = -(1 << 63)

U = np.uint64
MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
BASES = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)

RUN, COVERED, MARK = 1, 0, -1
ANCHORS = "core long, salt int, full long, rep long, c1 long, run long, kind int"
SPANS = "rep long, c1 long, begin long, end long"
SUFFIXES = "part long, core long, rep long, c1 long, begin long, ahead int, bytes binary"
KEPT = "rep long, c1 long, digest string, n_bytes long, n_removed long, n_spans long, kept binary"


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, int(n).bit_length()))


class Hashes:
    """Hashes of any substrings of a byte string of at least GRAM bytes, from prefix sums of mixed 8-byte grams."""

    def __init__(self, data: bytes, base: int = BASES[0], salt: int = 0):
        n = len(data) - GRAM + 1
        grams = np.ndarray(n, "<u8", data, 0, (1,)) * (MIX_A ^ U(salt))
        grams ^= grams >> U(29)
        grams *= MIX_B
        grams ^= grams >> U(32)
        self.grams, self.inverse = grams, powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(grams * powers(base, n)[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end - GRAM + 1] - self.sums[begin]) * self.inverse[begin]


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, first and last window of each run, core hash and context hash, for data of at least LENGTH bytes.

    Long data are looked at in pieces of PIECE bytes with margins, cut between runs, so memory is bounded.
    """
    total, window = len(data), 0
    while True:
        begin = max(0, window - WINDOW)
        at, first, last, core, full = _anchors(data[begin : begin + PIECE])
        at, first, last = at + begin, first + begin, last + begin
        use = first >= window
        rest = begin + PIECE < total
        if rest:
            use &= (at + LENGTH <= begin + PIECE) & (np.arange(len(at)) < len(at) - 1)
        yield at[use], first[use], last[use], core[use], full[use]
        if not rest:
            return
        window = int(last[use][-1]) + 1


def _anchors(data: bytes) -> tuple[np.ndarray, ...]:
    n, hashes = len(data), Hashes(data)
    places = n - LENGTH + WINDOW
    least = (hashes.grams[:places] & U(0xFFFFFFFF00000000)) | np.arange(places, dtype=U)  # ties: the leftmost
    width = 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - LENGTH]))
    at = at[first]
    left, right = np.maximum(0, at - WINDOW + 1), np.minimum(n, at + LENGTH)
    core = hashes.of(at, at + CORE)
    full = (hashes.of(left, right) ^ ((right - at) * 256 + (at - left)).astype(U) * MIX_B) * MIX_A
    return at, first, last, core, full


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def first_two(core: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Whether a run is the first or second of its context."""
    order = np.argsort(core * MIX_A ^ full, kind="stable")
    c, f = core[order], full[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (f[1:] != f[:-1])))
    nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = nth < 2
    return out


def map_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts' anchors; run packs anchor and window range.

    Of the runs of one context that a batch repeats, two go on; the bytes that windows of the others cover are given as
    rows of kind COVERED, whose core is scattered, so they only pass through. A core that is hot in a batch has a MARK.
    """
    schema, seen = arrow_schema(ANCHORS), set()

    def rows(found: list[tuple], reps: list[int], c1s: list[int]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        at, first, last, core, full = (np.concatenate(c) for c in zip(*found, strict=True))
        rep, c1 = np.array(reps, np.int64), np.array(c1s, np.int64)
        keep = first_two(core, full)
        begin, end = merged(first[~keep] + (of[~keep] << 32), last[~keep] + LENGTH + (of[~keep] << 32))
        owner, begin, end = begin >> 32, begin & 0xFFFFFFFF, end & 0xFFFFFFFF
        scattered = ((begin.astype(U) + c1[owner].view(U)) * MIX_A).view(np.int64)
        run, of, core, full = (at << 16 | (at - first) << 8 | (at - last))[keep], of[keep], core[keep], full[keep]
        cores, which, counts = np.unique(core, return_inverse=True, return_counts=True)
        hot = cores[counts > HOT_BATCH].view(np.int64)
        salt = np.where((counts > HOT_BATCH)[which], (full * MIX_B >> U(32)).astype(np.int64) % SALTS + 1, 0)
        n, m, none = len(of), len(owner), np.zeros(len(hot), np.int64)
        columns = (
            (core.view(np.int64), scattered, hot),
            (salt.astype(np.int32), np.zeros(m + len(hot), np.int32)),
            (full.view(np.int64), end, none),
            (rep[of], rep[owner], none),
            (c1[of], c1[owner], none),
            (run, begin, none),
            (np.full(n, RUN, np.int32), np.full(m, COVERED, np.int32), np.full(len(hot), MARK, np.int32)),
        )
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        found, reps, c1s, size = [], [], [], 0
        for rep, c1, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(data) < LENGTH or (digest := hashlib.md5(data).digest()) in seen:
                continue  # texts with a copy go whole, so one of a task's copies is enough for others to match
            if len(seen) < REMEMBERED_TEXTS:
                seen.add(digest)
            for piece in anchors(data):
                found.append(piece)
                reps.append(rep)
                c1s.append(c1)
                size += len(piece[0])
                if size >= BATCH_RUNS:
                    yield rows(found, reps, c1s)
                    found, reps, c1s, size = [], [], [], 0
        if found:
            yield rows(found, reps, c1s)


def map_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs to index; hot cores are cut in groups of windows with a part of their own.

    Of the groups of equal bytes (by 128 bits) that a task has, two go on; the others are repeated as these are: they are told
    by a negative length instead of the place of the anchor, without bytes and with a part of their own.
    """
    schema, seen = arrow_schema(SUFFIXES), Counter()
    for batch in batches:
        rows = []
        for rep, c1, data, work in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(0, len(work), 3):
                core, run, hot = work[i : i + 3]
                at = run >> 16
                first, last = at - (run >> 8 & 255), at - (run & 255)
                if not hot:
                    rows.append((core, core, rep, c1, first, at - first, data[first : last + LENGTH]))
                    continue
                # groups are counted from the anchor, so equal windows are in groups with equal common bytes
                for group in range((at - last) // GROUP, (at - first) // GROUP + 1):
                    a, b = max(first, at - group * GROUP - GROUP + 1), min(last, at - group * GROUP)
                    common = data[at - group * GROUP : at - group * GROUP - GROUP + 1 + LENGTH]
                    digest = hashlib.blake2b(common, digest_size=8, key=group.to_bytes(2, "little")).digest()
                    part, held = int.from_bytes(digest, "little", signed=True), data[a : b + LENGTH]
                    key = core, at - a, hashlib.blake2b(held, digest_size=16).digest()
                    if seen[key] >= 2:
                        rows.append((c1 ^ a, core, rep, c1, a, -len(held), b""))
                        continue
                    if len(seen) < REMEMBERED_GROUPS:
                        seen[key] += 1
                    rows.append((part, core, rep, c1, a, at - a, held))
                if len(rows) >= 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Suffixes:
    """Places in ``data`` where suffixes begin, each with the route on which equal ones meet."""

    def __init__(self, data: bytes, at: np.ndarray, route: np.ndarray):
        self.data, self.at, self.route = data, at, route
        self.words = np.ndarray(max(0, len(data) - GRAM + 1), "<u8", data, 0, (1,))

    def word(self, k: int, which: np.ndarray) -> np.ndarray:
        """The k-th eight bytes of some suffixes, as numbers in the order of the bytes."""
        return self.words[self.at[which] + GRAM * k].byteswap()

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes by route and first LENGTH bytes, and which of them, in that order, differ from the one before."""
        order = np.argsort(self.route, kind="stable")
        route = self.route[order]
        new = np.concatenate(([True], route[1:] != route[:-1]))
        tied = np.arange(len(order))
        for k in range(LENGTH // GRAM):
            alone = new & np.concatenate((new[1:], [True]))
            tied = tied[~alone[tied]]
            if not len(tied):
                break
            key, group = self.word(k, order[tied]), np.cumsum(new[tied])
            inside = group[1:] == group[:-1]
            apart = inside & (key[1:] != key[:-1])
            if not apart.any():
                continue
            mixed = np.isin(group, group[1:][apart])  # groups of ties that this word sorts
            part, key = tied[mixed], key[mixed]
            by = np.lexsort((key, group[mixed]))
            order[part], key = order[part][by], key[by]
            new[part[1:][(group[mixed][1:] == group[mixed][:-1]) & (key[1:] != key[:-1])]] = True
        return order, new


class Level:
    """A sorted array of different suffix beginnings, with the number of one suffix of each (or -1)."""

    def __init__(self, suffixes: Suffixes, owner: np.ndarray):
        self.suffixes, self.owner = suffixes, owner

    def find(self, sought: Suffixes) -> np.ndarray:
        """Place of each sought beginning, or -1; both sides are sorted: a merge scan by route, then by bytes."""
        mine = self.suffixes
        low = np.searchsorted(mine.route, sought.route)
        found = np.full(len(low), -1)
        open_ = np.flatnonzero(low < len(mine.route))
        open_ = open_[mine.route[low[open_]] == sought.route[open_]]
        low, high = low[open_], np.searchsorted(mine.route, sought.route[open_], side="right")
        while len(open_):
            middle = (low + high) // 2
            side = compare(mine, middle, sought, open_)
            found[open_[side == 0]] = middle[side == 0]
            low, high = np.where(side < 0, middle + 1, low), np.where(side > 0, middle, high)
            go_on = (side != 0) & (low < high)
            open_, low, high = open_[go_on], low[go_on], high[go_on]
        return found


def compare(a: Suffixes, i: np.ndarray, b: Suffixes, j: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the first LENGTH bytes of suffixes ``i`` of ``a`` are less than, equal to or greater than ``j`` of ``b``."""
    out, open_ = np.zeros(len(i), np.int8), np.arange(len(i))
    for k in range(LENGTH // GRAM):
        x, y = a.word(k, i[open_]), b.word(k, j[open_])
        differ = x != y
        if differ.any():
            out[open_[differ]] = np.where(x[differ] < y[differ], -1, 1)
            open_ = open_[~differ]
            if not len(open_):
                break
    return out


class SuffixFamily:
    """Levels of geometrically growing size; ``add`` gives the suffixes, old and new, now known to be repeated."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.n = 0

    def add(self, batch: Suffixes) -> np.ndarray:
        """Numbers of the suffixes, counted over all batches, that this batch shows to be repeated."""
        number = np.arange(self.n, self.n + len(batch.at))
        self.n += len(batch.at)
        order, new = batch.order()
        number, group = number[order], np.cumsum(new) - 1
        repeated = np.bincount(group) > 1
        heads = Suffixes(batch.data, batch.at[order][new], batch.route[order][new])
        owner, known, told = number[new].copy(), np.zeros(len(heads.at), bool), []
        for level in self.levels:
            at = level.find(heads)
            hit = at >= 0
            known |= hit
            owners = level.owner[at[hit]]
            told.append(owners[owners >= 0])
            level.owner[at[hit]] = -1
        told.append(number[(repeated | known)[group]])
        owner[repeated | known] = -1
        self._push(Level(Suffixes(heads.data, heads.at[~known], heads.route[~known]), owner[~known]))
        return np.concatenate(told)

    def _push(self, level: Level) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].owner) < 2 * len(self.levels[-1].owner):
            b, a = self.levels.pop(), self.levels.pop()
            data = a.suffixes.data + b.suffixes.data
            both = Suffixes(data, np.concatenate([a.suffixes.at, b.suffixes.at + len(a.suffixes.data)]), np.concatenate([a.suffixes.route, b.suffixes.route]))
            order, _ = both.order()
            self.levels.append(Level(Suffixes(data, both.at[order], both.route[order]), np.concatenate([a.owner, b.owner])[order]))


def map_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated windows among a task's suffixes."""
    schema, family = arrow_schema(SPANS), SuffixFamily()
    owners = [np.zeros(0, np.int64) for _ in range(3)]  # of each run of suffixes: rep, c1, first window
    edges = np.zeros(1, np.int64)  # number of the first suffix of each run

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        nonlocal owners, edges
        cores, reps, c1s, begins, ahead, data = (list(c) for c in zip(*rows, strict=True))
        sizes = np.array(list(map(len, data)))
        ends, counts = np.cumsum(sizes), sizes - LENGTH + 1
        of = np.repeat(np.arange(len(rows)), counts)
        nth = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
        place = (np.array(ahead)[of] - nth).astype(U)  # from the window's start to its anchor
        route = (np.array(cores, np.int64).view(U)[of] ^ place * MIX_A) * MIX_B
        owners = [np.concatenate([o, np.array(v, np.int64)]) for o, v in zip(owners, (reps, c1s, begins), strict=True)]
        edges = np.concatenate([edges, edges[-1] + np.cumsum(counts)])
        told = np.sort(family.add(Suffixes(b"".join(data), nth + (ends - sizes)[of], route)))
        if not len(told):
            return None
        run = np.searchsorted(edges, told, side="right") - 1
        new = np.concatenate(([True], (told[1:] != told[:-1] + 1) | (run[1:] != run[:-1])))
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(told) - 1]))
        run = run[new]
        begin = owners[2][run] + told[new] - edges[run]
        end = owners[2][run] + told[last] - edges[run] + LENGTH
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (owners[0][run], owners[1][run], begin, end)], schema=schema)

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        known = batch.filter(pc.less(batch.column(5), 0))
        if known.num_rows:
            ends = pc.subtract(known.column(4), known.column(5).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), known.column(4), ends], schema=schema)
        for row in zip(*(c.to_pylist() for c in batch.filter(pc.greater_equal(batch.column(5), 0)).columns[1:]), strict=True):
            rows.append(row)
            size += len(row[-1]) - LENGTH + 1
            if size >= BATCH_SUFFIXES:
                if (out := flush(rows)) is not None:
                    yield out
                rows, size = [], 0
    if rows and (out := flush(rows)) is not None:
        yield out


def to_characters(data: bytes, begin: int, end: int) -> tuple[int, int]:
    """A span widened to whole UTF-8 characters."""
    while begin and begin < len(data) and 0x80 <= data[begin] < 0xC0:
        begin -= 1
    while end < len(data) and 0x80 <= data[end] < 0xC0:
        end += 1
    return begin, end


def map_removal(batches: Iterator[pa.RecordBatch], characters: bool = False) -> Iterator[pa.RecordBatch]:
    """What is left of each document after its spans go; with ``characters``, a character goes whole if a part of it does."""
    schema = arrow_schema(KEPT)
    for batch in batches:
        rows = []
        for rep, c1, data, spans in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            packed = np.array(spans or [], np.int64)
            begin, end = merged(packed >> 32, packed & 0xFFFFFFFF)
            kept, at = [], 0
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                a, b = to_characters(data, a, b) if characters else (a, b)
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((rep, c1, hashlib.md5(data).hexdigest(), len(data), int((end - begin).sum()), len(begin), b"".join(kept)))
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(4)], names=[*schema.names, "rest"])


def remove_repeats(docs: DataFrame, kept: str = "kept", carry: list[str] | None = None, characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, ``kept`` (an expression over the kept bytes) and rest for every row of ``docs``.

    rest is a struct of the columns named in ``carry``, taken along in the one shuffle of texts. With ``characters`` no
    character is cut: what is kept loses those of which a part is removed (the counts are those of the bytes).
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = F.struct(*(docs[c] for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rep"), text_bytes().alias("bytes"), rest.alias("rest"))
    texts = texts.select("rep", F.xxhash64("bytes").alias("c1"), "bytes", "rest")
    kept_schema = StructType([*StructType.fromDDL(KEPT), texts.schema["rest"]])

    # two runs of each context go to the family of their core; those beyond are repeated as these are
    core = Window.partitionBy("core", "salt")
    same = Window.partitionBy("core", "salt", "kind", "full")
    judged = map_arrow(texts.select("rep", "c1", "bytes"), map_anchors, ANCHORS).repartition(n, "core", "salt")
    judged = judged.select("*", F.row_number().over(same.orderBy("rep", "c1", "run")).alias("nth"))
    count = lambda condition: F.sum(F.expr(condition).cast("long")).over(core)
    judged = judged.select("*", count(f"kind = {RUN} and nth = 1").alias("contexts"), count(f"kind = {RUN}").alias("runs"), count(f"kind = {MARK}").alias("marks"))
    judged = judged.withColumn("hot", F.expr(f"salt > 0 or marks > 0 or contexts > {HOT_CORE}"))
    span = F.expr(f"""case when kind = {COVERED} then shiftleft(run, 32) | full
                      when kind = {RUN} and nth > 2 then shiftleft((run >> 16) - ((run >> 8) & 255), 32) | ((run >> 16) - (run & 255) + {LENGTH}) end""")
    work = F.when(F.expr(f"kind = {RUN} and nth <= 2 and (hot or runs > 1)"), F.struct("core", "run", F.col("hot").cast("long").alias("hot")))
    judged = judged.select("rep", "c1", span.alias("span"), work.alias("work")).filter("span is not null or work is not null")
    judged = judged.groupBy("rep", "c1").agg(F.collect_list("span").alias("spans"), F.collect_list("work").alias("work"))
    judged = cut(judged.select("rep", "c1", "spans", F.flatten(F.transform("work", lambda x: F.array(x["core"], x["run"], x["hot"]))).alias("work")))
    tasks = max(n, -(-int(judged.agg(F.sum(F.size("work"))).first()[0] or 0) // (3 * TASK_RUNS)))

    # the one shuffle of texts, which both uses share
    dealt = texts.repartition(n, "rep", "c1")
    opened = dealt.join(judged.filter("size(work) > 0").select("rep", "c1", "work").hint("shuffle_hash"), ["rep", "c1"])
    suffixes = map_arrow(opened.select("rep", "c1", "bytes", "work"), map_suffixes, SUFFIXES).repartition(tasks, "part")
    spans = map_arrow(suffixes, map_families, SPANS).groupBy("rep", "c1").agg(F.collect_list(F.expr("shiftleft(begin, 32) | end")).alias("found"))
    spans = judged.select("rep", "c1", "spans").join(spans, ["rep", "c1"], "full").select("rep", "c1", F.concat(F.coalesce("spans", F.array().cast("array<long>")), F.coalesce("found", F.array().cast("array<long>"))).alias("spans"))
    left = dealt.join(spans.hint("shuffle_hash"), ["rep", "c1"], "left").select("rep", "c1", "bytes", "spans", "rest")
    left = map_arrow(left, functools.partial(map_removal, characters=characters), kept_schema)

    # texts that have a copy go whole; a group of them is dealt over SALTS keys
    copied = texts.groupBy(F.md5("bytes").alias("digest")).agg(F.count("*").alias("copies")).filter("copies > 1")
    copied = copied.select("digest", F.lit(True).alias("copied"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = left.select("rep", "digest", "n_bytes", "n_removed", "n_spans", F.expr(kept).alias("kept"), "rest", F.pmod(F.xxhash64("rep", "digest"), F.lit(SALTS)).cast("int").alias("salt"))
    left = left.join(copied, ["digest", "salt"], "left")
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return left.select(
        F.when(F.col("rep") != NO_ID, F.col("rep")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.expr(kept.replace("kept", "cast('' as binary)"))).otherwise(F.col("kept")).alias("kept"),
        "rest",
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir), "sha2(kept, 256)").drop("rest").withColumnRenamed("kept", "kept_sha256")
