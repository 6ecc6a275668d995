"""Cross-tokenizer alignment: which tokens of two tokenizers overlap in a text, in which groups, and how often in a corpus.

A static interval index holds the byte ranges of a text's B tokens; the range of each A token is looked up in it by
bisection, which lists the B tokens that it overlaps. Gaps between B tokens that no A token spans become the boundaries of
groups. Neither tokenizer looks across a space that follows other text, so texts are cut there: a text's alignment is that
of its stretches one after another. A worker remembers frequent stretches and aligns all new ones of some texts at once.

The corpus is read twice. The first pass counts linked id pairs, combined in each task before the shuffle; the second
sums each text's counts. The HELD most frequent pairs are looked up in a broadcast table of bounded size (16 bytes and a
flag each); texts with links of other pairs, of which none is frequent, get the rest by a shuffled join.

Defined results: null and empty texts, and those whose joined tokens are not the text's bytes (a text with U+2581, which B
takes for a space), have no tokens, so zeros and an empty digest; special-token strings are ordinary text; repeated rows
count each and give equal rows; ties for the best count are all best; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow, read_documents
from lakelens.session import cut

#: Before a space that follows neither white space, in any tokenizer's sense, nor B's mark of a space.
CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85\u180e\u200b\u2060\u2581\ufeff])(?= )")
#: A space before which no text may be cut.
KEPT = re.compile("[\\s\x1c-\x1f\x85\u180e\u200b\u2060\u2581\ufeff] ")
MARK = "\u2581"
#: What ``str.isspace`` leaves out of those.
UNSEEN = "\u180e\u200b\u2060\u2581\ufeff"
#: Characters of texts that are taken together and of stretches that are encoded together, pairs that a task holds before
#: it hands them on, and stretches that a worker remembers.
TAKEN_CHARS, JOINED_CHARS = 4_000_000, 20_000
TALLIED = 2_000_000
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
#: Pairs whose counts are broadcast.
HELD = 2_000_000


class IntervalIndex:
    """Static index over consecutive byte ranges: the first and the end of the run of them that each given range overlaps."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.ends, starts, side="right"), np.searchsorted(self.starts, ends, side="left")


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each A token the first B token that it overlaps and the one after the last; for each B token whether an A token
    spans the gap after it."""
    a_ends = np.cumsum(a_sizes)
    first, end = IntervalIndex(b_sizes).stab(a_ends - a_sizes, a_ends)
    # a token that overlaps B tokens i to j spans the gaps after i to j - 1
    open_ = np.bincount(first, minlength=len(b_sizes) + 1) - np.bincount(end - 1, minlength=len(b_sizes) + 1)
    return first, end, np.cumsum(open_)[: len(b_sizes)] > 0


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligned(NamedTuple):
    """Of stretches: numbers of A and B tokens, groups and links; keys of all links' id pairs; groups as text; which are broken."""

    sizes: np.ndarray
    keys: np.ndarray
    shown: list[str]
    broken: np.ndarray


class Aligner:
    """Two tokenizers and what is known of stretches; A is a byte-level one, B one of pieces that adds a space."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte = byte_level()
        vocabulary = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        # ids as they are written at the start of a stretch, of a group and inside one; B ids after the bar and inside
        self.written = [f"{mark}{i}" for mark in ("", ";", ",") for i in range(len(self.a_bytes))] + [f"{mark}{i}" for mark in ("|", ",") for i in range(len(self.b_bytes))]
        #: Pieces that hold a space after other text could be merged across a cut: then texts stay whole.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.worth, self.writes = 0, True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.memo = Aligned(np.zeros((0, 4), np.int64), np.zeros(0, np.int64), [], np.zeros(0, bool))

    def stretches(self, text: str) -> list[str]:
        """Parts of a space and ``text``, each without the space that it begins with."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        return [s[1:] for s in CUT.split(f" {text}")] if text[0] == " " or KEPT.search(text) else text.split(" ")

    def _encoded(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of the joined stretches by A and B; None if either does not give the bytes back."""
        joined, starts, chars = [], 0, 0
        texts: list[str] = []
        for k, s in enumerate(stretches):
            chars += len(s)
            # after an empty stretch or white space, as a text may end, a space is no cut: tokens would span it
            if chars >= JOINED_CHARS or k == len(stretches) - 1 or not s or s[-1].isspace() or s[-1] in UNSEEN:
                joined.append(stretches[starts : k + 1])
                texts.append(" ".join(joined[-1]))
                starts, chars = k + 1, 0
        of_a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        of_b = self.b.encode(texts, num_threads=1) if texts else []
        out: list[tuple[list[int], list[int]] | None] = []
        for group, text, a, b in zip(joined, texts, of_a, of_b, strict=True):
            data = f" {text}".encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b)):
                out.append((a, b))
            else:
                out += [None] if len(group) == 1 else [x for s in group for x in self._encoded([s])]
        return out

    def aligned(self, stretches: list[str]) -> Aligned:
        """All stretches at once: they are one sequence of bytes, whose ends are ends of tokens of both."""
        encoded = self._encoded(stretches)
        if None in encoded:  # then those that were joined with a broken one stand alone
            encoded = self._encoded_alone(stretches)
            broken = np.array([x is None for x in encoded])
        else:
            broken = np.zeros(len(stretches), bool)
        parts = [x for x in encoded if x is not None]
        a, b = (np.fromiter(chain.from_iterable([x[k] for x in parts]), np.int64) for k in (0, 1))
        first, end, spanned = align(self.a_sizes[a], self.b_sizes[b])
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([0 if x else len(s.encode()) + 1 for s, x in zip(stretches, broken.tolist(), strict=True)])
        # ends of each stretch among A tokens, B tokens, groups and links
        closes = np.cumsum(~spanned)
        to_a, to_b = np.searchsorted(a_ends, ends, side="right"), np.searchsorted(b_ends, ends, side="right")
        per_a = end - first
        links = np.concatenate([[0], np.cumsum(per_a)])
        to = np.stack([to_a, to_b, np.concatenate([[0], closes])[to_b], links[to_a]], axis=1)
        sizes = np.diff(to, axis=0, prepend=0)
        left = np.repeat(np.arange(len(a)), per_a)
        right = np.arange(len(left)) - np.repeat(links[:-1], per_a) + np.repeat(first, per_a)
        shown = self._shown(a, b, first, spanned, closes, to_a, to_b) if self.writes else [""] * len(stretches)
        return Aligned(sizes, a[left] << 32 | b[right], shown, broken)

    def _encoded_alone(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        return [x for s in stretches for x in self._encoded([s])]

    def _shown(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, spanned: np.ndarray, closes: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[str]:
        """Each stretch's groups as text: the A ids of a group, then its B ids, in one sequence of written ids."""
        b_group = closes - ~spanned  # groups that are closed before a B token
        a_group = b_group[first]
        starts = np.concatenate([[0], to_a[:-1]])
        a_mark = np.where(np.diff(a_group, prepend=-1) > 0, 1, 2)
        a_mark[starts[starts < to_a]] = 0
        b_mark = np.where(np.diff(b_group, prepend=-1) > 0, 0, 1)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.searchsorted(b_group, a_group, side="left")] = a_mark * len(self.a_bytes) + a
        out[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = 3 * len(self.a_bytes) + b_mark * len(self.b_bytes) + b
        words, ends = list(map(self.written.__getitem__, out.tolist())), (to_a + to_b).tolist()
        return ["".join(words[s:e]) for s, e in zip([0, *ends], ends, strict=False)]

    def split(self, texts: list[str]) -> tuple[list[int], np.ndarray, pa.Array]:
        """The stretches of all texts, one after another; the texts in the order in which they come, and their numbers of stretches.

        Texts that may be cut at every space are cut by Arrow and come first.
        """
        plain = [bool(t) and self.cuts and t[0] != " " and not KEPT.search(t) for t in texts]
        order = [i for i, p in enumerate(plain) if p] + [i for i, p in enumerate(plain) if not p]
        words = pc.split_pattern(pa.array([texts[i] for i in order[: sum(plain)]], pa.large_string()), " ")
        others = [self.stretches(texts[i]) for i in order[sum(plain) :]]
        sizes = np.concatenate([pc.list_value_length(words).to_numpy(), np.array(list(map(len, others)), np.int64)])
        return order, sizes, pa.concat_arrays([words.flatten(), pa.array(list(chain.from_iterable(others)), pa.large_string())])

    def learn(self, stretches: list[str], times: list[int]) -> tuple[list[str], Aligned]:
        """What is new of different ``stretches``, whose places follow the remembered ones until ``settle``.

        Those that are worth remembering, being short and there more than once, come first; half of the room is for any.
        """
        fresh = [(s, n) for s, n in zip(stretches, times, strict=True) if s not in self.known]
        often = [s for s, n in fresh if n > 1 and len(s) <= REMEMBERED_CHARS]
        once = [s for s, n in fresh if n == 1 and len(s) <= REMEMBERED_CHARS]
        self.worth = len(often) + min(len(once), max(0, REMEMBERED // 2 - len(self.known)))
        new = often + once + [s for s, _ in fresh if len(s) > REMEMBERED_CHARS]
        found = self.aligned(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return new, found

    def settle(self, new: list[str], found: Aligned) -> int:
        """Remember new stretches that are worth it while there is room and forget the others; how many were kept."""
        before = len(self.memo.shown)
        keep = max(0, min(REMEMBERED - before, self.worth))
        for s in new[keep:]:
            del self.known[s]
        if keep:
            links = int(found.sizes[:keep, 3].sum())
            self.memo = Aligned(np.concatenate([self.memo.sizes, found.sizes[:keep]]), np.concatenate([self.memo.keys, found.keys[:links]]), self.memo.shown + found.shown[:keep], np.concatenate([self.memo.broken, found.broken[:keep]]))
        return keep

    def whole(self, text: str) -> Aligned:
        """Without cuts: decides on texts with a stretch that is not given back."""
        return self.aligned([text])


@functools.lru_cache(maxsize=1)
def _load(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def load(path_a: str, path_b: str, writes: bool = True) -> Aligner:
    """One for each worker process; what it remembers has groups as text or, without ``writes``, has not."""
    aligner = _load(path_a, path_b)
    if aligner.writes != writes:
        aligner.writes = writes
        aligner.forget()
    return aligner


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of a bounded number of characters, or of one text."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and chars + len(text) > TAKEN_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(text)
            chars += len(text)
    if ids:
        yield ids, texts


class Placed(NamedTuple):
    """Texts, in the order given, as places of their stretches, one text after another; ``ends`` are those of the texts."""

    order: list[int]
    places: np.ndarray
    ends: np.ndarray
    new: list[str]
    found: Aligned

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's stretches."""
        total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values[self.places], axis=0)])
        return np.diff(total[np.concatenate([[0], self.ends])], axis=0)


def placed(aligner: Aligner, texts: list[str]) -> Placed:
    """To be followed by ``aligner.settle``."""
    order, sizes, flat = aligner.split(texts)
    coded = flat.dictionary_encode()  # most stretches come again and again, so each is looked up once
    values, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    new, found = aligner.learn(values, np.bincount(index, minlength=len(values)).tolist())
    places = np.fromiter(map(aligner.known.__getitem__, values), np.int64, len(values))
    return Placed(order, places[index], np.cumsum(sizes, dtype=np.int64), new, found)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b and n: how many links of all texts are of that id pair."""
    schema = arrow_schema("a int, b int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, path_b, writes=False)
        seen = np.zeros(len(aligner.known), np.int64)  # of remembered stretches, whose links are counted at the end
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def handed_on() -> pa.RecordBatch:
            keys, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], schema=schema)

        for _, texts in taken(batches):
            p = placed(aligner, texts)
            broken = p.per_text(np.concatenate([aligner.memo.broken, p.found.broken]).astype(np.int64)) > 0
            good = np.repeat(~broken, np.diff(p.ends, prepend=0))
            counts = np.bincount(p.places[good], minlength=len(aligner.known))
            for i in np.flatnonzero(broken).tolist():
                held.append((keys := aligner.whole(texts[p.order[i]]).keys, np.ones(len(keys), np.int64)))
            before = len(seen)
            keep = aligner.settle(p.new, p.found)
            seen = np.concatenate([seen, np.zeros(keep, np.int64)]) + counts[: before + keep]
            loose = p.found.keys[int(p.found.sizes[:keep, 3].sum()) :]
            held.append(summed(loose, np.repeat(counts[before + keep :], p.found.sizes[keep:, 3])))
            if sum(len(k) for k, _ in held) > TALLIED:
                yield handed_on()
        held.append((aligner.memo.keys, np.repeat(seen, aligner.memo.sizes[:, 3])))
        last = handed_on()
        yield last.filter(pc.greater(last.column(2), 0))

    return map_arrow(_texts(docs), run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` and whether a pair's count is the highest of its B id."""
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


class Counts(NamedTuple):
    """Counts of id pairs in the order of their keys."""

    keys: np.ndarray
    n: np.ndarray
    best: np.ndarray

    def of(self, found: Aligned) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Best links and summed counts of each stretch; the keys that are not held, by the place of their stretch."""
        ends = np.concatenate([[0], np.cumsum(found.sizes[:, 3])])
        if not len(self.keys):
            return np.zeros((len(found.sizes), 2), np.int64), {}
        at = np.minimum(np.searchsorted(self.keys, found.keys), len(self.keys) - 1)
        held = self.keys[at] == found.keys
        values = np.stack([self.best[at] & held, np.where(held, self.n[at], 0)], axis=1).astype(np.int64)
        total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)])
        missing = np.flatnonzero(~held)
        others: dict[int, list[int]] = {}
        for place, key in zip((np.searchsorted(ends, missing, side="right") - 1).tolist(), found.keys[missing].tolist(), strict=True):
            others.setdefault(place, []).append(key)
        return np.diff(total[ends], axis=0), others


def held_counts(counts: DataFrame, most: int) -> tuple[Counts, DataFrame | None]:
    """The ``most`` most frequent pairs of a written table, and the other ones if there are any."""
    size, rest = counts.count(), None
    if size > most:
        rest = cut(counts.orderBy(F.desc("n"), "a", "b").offset(most))
        counts = counts.orderBy(F.desc("n"), "a", "b").limit(most)
    key = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    table = counts.select(key.alias("key"), "n", "best").toArrow()  # at most ``most`` narrow rows
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    return Counts(keys[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]), rest


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_documents(docs: DataFrame, path_a: str, path_b: str, held: int | None = None) -> DataFrame:
    """Every row's numbers of tokens, groups and links, links with the best count of their B id, summed counts, groups' digest."""
    spark = docs.sparkSession
    held = HELD if held is None else held
    known, rest = held_counts(cut(with_best(cut(link_counts(docs, path_a, path_b)))), held)
    table = spark.sparkContext.broadcast(known)
    schema = arrow_schema(f"row long, {OUT}, others array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = load(path_a, path_b), table.value
        row = TaskContext.get().partitionId() << 33
        best, others = counts.of(aligner.memo)

        for ids, texts in taken(batches):
            p = placed(aligner, texts)
            new_best, new_others = counts.of(p.found)
            broken = np.concatenate([aligner.memo.broken, p.found.broken]).astype(np.int64)
            numbers = np.concatenate([np.concatenate([aligner.memo.sizes, p.found.sizes]), np.concatenate([best, new_best]), broken[:, None]], axis=1)
            shown, rare = aligner.memo.shown + p.found.shown, others | {len(best) + k: x for k, x in new_others.items()}
            rows, start = [], 0
            for at, sums, end in zip(p.order, p.per_text(numbers).tolist(), p.ends.tolist(), strict=True):
                places, start = p.places[start:end].tolist(), end
                groups, more = list(map(shown.__getitem__, places)), [k for x in places if x in rare for k in rare[x]] if rare else []
                if sums[-1]:
                    alone = aligner.whole(texts[at])
                    of_alone, rare_alone = counts.of(alone)
                    sums, groups, more = [*alone.sizes[0].tolist(), *of_alone[0].tolist(), 0], [] if alone.broken[0] else alone.shown, rare_alone.get(0, [])
                rows.append((row, ids[at], *sums[:-1], hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", more))
                row += 1
            keep = aligner.settle(p.new, p.found)
            others |= {len(best) + k: x for k, x in new_others.items() if k < keep}
            best = np.concatenate([best, new_best[:keep]])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = map_arrow(_texts(docs), run, f"row long, {OUT}, others array<long>")
    names = [c.split()[0] for c in OUT.split(", ")]
    if rest is None:
        return found.select(*names)
    found = cut(found)
    links = found.select("row", F.explode("others").alias("key"))
    a, b = F.shiftright("key", 32).cast("int"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int")
    more = links.select("row", a.alias("a"), b.alias("b")).join(rest, ["a", "b"]).groupBy("row").agg(F.sum("n").alias("more_n"), F.sum(F.col("best").cast("long")).alias("more_best"))
    added = {"n_best": "more_best", "count_sum": "more_n"}
    return found.join(more, "row", "left").select(*((F.col(c) + F.coalesce(F.col(added[c]), F.lit(0))).alias(c) if c in added else F.col(c) for c in names))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
