"""Packing of examples into training sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing, one open sequence at a time: of the pieces in a task's pool that fit all limits, that with the
greatest dot product of its demand and the room left goes in, both as shares of the limits. When none fits, the piece with
the greatest product is cut so that its head fills the sequence (``cut``; instruction examples are better left whole). A
sequence that has reached its number of segments or loss-bearing tokens, or is the last of a task, gives back what is
beyond a power of two, so nothing is padded if pieces may be cut. Parts of an example as long as a sequence are sequences of their own.

Everything is one pass without a shuffle: a task encodes, packs and hands on what it reads and holds POOL pieces of less
than a sequence each. A sequence never mixes rows of two tasks, so a task adds a dozen short ones at most. A sequence's id
is its task's number and its number there; write the result before it is read twice if the input is not a scan.

Defined results: null and empty texts are the end id alone; texts of any length are encoded whole; repeated rows are
examples of their own; ties go to the piece that came first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow, read_documents
from lakelens.llm.wavelet import load
from lakelens.session import spread

POOL = 2048
#: Rows and characters that are encoded at once.
ENCODE_ROWS = 3000
ENCODE_CHARS = 4_000_000


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece(NamedTuple):
    """A stretch of an example: its ids and which of them bear loss; ``total`` counts all ids of the example."""

    key: int | None
    start: int
    ids: np.ndarray
    bears: np.ndarray
    total: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n], bears=self.bears[:n]), self._replace(start=self.start + n, ids=self.ids[n:], bears=self.bears[n:])

    def own(self) -> Piece:
        """With arrays of its own, so that a short tail does not keep a long example's."""
        return self._replace(ids=self.ids.copy(), bears=self.bears.copy())


class Packer:
    """A pool of pieces and the sequences that are packed of them."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True, pool: int = POOL):  # noqa: B008
        if min(limits) < 1:
            raise ValueError(f"limits must be positive: {limits}")
        self.limits, self.cut, self.most = limits, cut, pool
        self.pieces: list[Piece] = []
        self.demand = np.zeros((0, 3))
        self.live = np.zeros(0, bool)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes an example; gives the sequences that are full by then. Examples beyond a limit are always cut."""
        while (n := self._head(piece, self.limits.tokens, self.limits.loss)) < len(piece.ids):
            head, piece = piece.split(n)
            if n == self.limits.tokens:
                yield [head]
            else:
                self.pieces.append(head.own())
        if len(piece.ids) == self.limits.tokens:
            yield [piece]
        else:
            self.pieces.append(piece.own())
        if len(self.pieces) >= self.most:
            yield from self.packed(self.most // 2)

    def packed(self, left: int = 0) -> Iterator[list[Piece]]:
        """Sequences of the pool's pieces until at most ``left`` pieces remain."""
        self.demand = np.array([self._demand(p) for p in self.pieces]).reshape(-1, 3)
        self.live = np.ones(len(self.pieces), bool)
        while (n := int(self.live.sum())) > left:
            sequence = self._fill()
            if len(self.pieces) > 2 * n + 64:
                self._compact()
            yield sequence
        self._compact()

    def _compact(self) -> None:
        keep = np.flatnonzero(self.live)
        self.pieces = [self.pieces[i] for i in keep.tolist()]
        self.demand, self.live = self.demand[keep], np.ones(len(keep), bool)

    def _demand(self, piece: Piece) -> tuple[int, int, int]:
        return len(piece.ids), 1, int(piece.bears.sum())

    def _head(self, piece: Piece, tokens: int, loss: int) -> int:
        """Ids of a piece's longest head within the room."""
        n = min(tokens, len(piece.ids))
        if piece.bears[:n].sum() > loss:
            n = int(np.searchsorted(np.cumsum(piece.bears[:n]), loss, side="right"))
        return n

    def _put_back(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.demand = np.vstack([self.demand, self._demand(piece)])
        self.live = np.append(self.live, True)

    def _fill(self) -> list[Piece]:
        limits = np.array(self.limits, float)
        room, taken = limits.copy(), []
        while room[1] >= 1 and room[0] >= 1:
            product = np.where(self.live, self.demand @ (room / limits**2), -1.0)
            fits = self.live & (self.demand <= room).all(axis=1)
            if fits.any():
                at = int(np.argmax(np.where(fits, product, -1.0)))
                piece = self.pieces[at]
                self.live[at] = False
            elif self.cut and self.live.any():
                at = int(np.argmax(product))
                n = self._head(self.pieces[at], int(room[0]), int(room[2]))
                if not n:
                    break
                piece, rest = self.pieces[at].split(n)
                self.pieces[at], self.demand[at] = rest, self._demand(rest)
            else:
                break
            taken.append(piece)
            room -= self._demand(piece)
        return self._to_power_of_two(taken) if self.cut and room[0] >= 1 else taken

    def _to_power_of_two(self, taken: list[Piece]) -> list[Piece]:
        """Gives back to the pool what a sequence holds beyond a power of two, which needs no padding."""
        extra = (n := sum(len(p.ids) for p in taken)) - (1 << n.bit_length() - 1)
        while extra:
            last = taken.pop()
            if len(last.ids) > extra:
                last, rest = last.split(len(last.ids) - extra)
                taken.append(last)
                self._put_back(rest)
                break
            extra -= len(last.ids)
            self._put_back(last)
        return taken


PIECES = "key long, start long, length long, ids binary, total long, sequence_id long, offset long, n_loss long"


def pack_examples(examples: DataFrame, path: str, end_id: int, limits: Limits = Limits(), cut: bool = True) -> DataFrame:  # noqa: B008
    """The pieces of every row of ``examples`` and where they lie.

    ``examples``: key; parts, an array of (text, bears); its ids are those of each text by the tokenizer at ``path``, then
    ``end_id``. Ids of parts that bear loss count against the limit of loss, the end id as the last part.
    """
    schema = arrow_schema(PIECES)
    end = np.array([end_id], "<u4")
    part = lambda p: F.struct(F.coalesce(p["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(p["bears"], F.lit(True)).alias("bears"))
    rows = examples.select(F.col("key").cast("long").alias("key"), F.transform(F.coalesce(F.col("parts"), F.array()), part).alias("parts"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        encoder = load(path)

        def pieces(held: list[tuple]) -> Iterator[Piece]:
            ids = iter(encoder.encode([p["text"] for _, parts in held for p in parts]))
            pa.default_memory_pool().release_unused()
            for key, parts in held:
                runs = [np.frombuffer(next(ids), "<u4") for _ in parts]
                whole = np.concatenate([*runs, end])
                flags = [p["bears"] for p in parts] or [True]
                bears = np.repeat([*flags, flags[-1]], [*map(len, runs), *[0] * (not runs), 1])
                yield Piece(key, 0, whole, bears, len(whole))

        held, chars = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(row)
                chars += sum(len(p["text"]) for p in row[1])
                if len(held) >= ENCODE_ROWS or chars >= ENCODE_CHARS:
                    yield from pieces(held)
                    held, chars = [], 0
        yield from pieces(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out, number = Packer(limits, cut), [], TaskContext.get().partitionId() << 33

        def sequences() -> Iterator[list[Piece]]:
            for piece in encoded(batches):
                yield from packer.add(piece)
            yield from packer.packed()

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for sequence in sequences():
            offset = 0
            for p in sequence:
                out.append((p.key, p.start, len(p.ids), p.ids.tobytes(), p.total, number, offset, int(p.bears.sum())))
                offset += len(p.ids)
            number += 1
            if len(out) >= 2000:
                yield handed_on()
                out.clear()
        if out:
            yield handed_on()

    return map_arrow(rows, run, PIECES)


def documents_as_examples(docs: DataFrame) -> DataFrame:
    """All ids of a document bear loss."""
    return docs.select(F.col("doc_id").alias("key"), F.array(F.struct(F.col("text").alias("text"), F.lit(True).alias("bears"))).alias("parts"))


def conversations_as_examples(conversations: DataFrame) -> DataFrame:
    """A conversation's turns in order, of which those of the assistant bear loss."""
    turn = F.struct(F.col("turn"), F.col("text").cast("string").alias("text"), (F.col("role").eqNullSafe("assistant")).alias("bears"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select(F.col("conv_id").alias("key"), F.transform("turns", lambda t: F.struct(t["text"].alias("text"), t["bears"].alias("bears"))).alias("parts"))


def whole_sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids as little-endian bytes, and (key, length) of its segments; a group holds a sequence, so it is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "key", "length")))
    found = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    segments = F.transform("parts", lambda p: F.struct(p["key"].alias("key"), p["length"].alias("length")))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return found.select("sequence_id", ids.alias("ids"), segments.alias("segments"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    examples = documents_as_examples(spread(read_documents(spark, sf_dir).select("doc_id", "text")))
    pieces = pack_examples(examples, public_tokenizers.path("word_bpe_49k.json"), 1)
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", digest, F.col("total").alias("doc_tokens"), "sequence_id", "offset", "n_loss")
