"""Byte-level BPE encoding and decoding in linear time from a rank file.

Bytes are mapped to Latin-1 so that the trie of one Aho-Corasick automaton over the vocabulary bounds the longest token at
each position of a piece. The encoding takes the longest token at each position, steps back to shorter ones when a token
can't stand after the one before, and marks positions from which no encoding goes on, so each position is left for good
at most once, and a position costs at most the longest token's length, whatever the length of the piece. Two tokens can stand together exactly if merging their joined bytes by rank gives the two again;
these answers are memoised. An encoding all of whose neighbours can stand together is the one that merging gives.

Defined results: null or empty text has no ids; any text round-trips byte for byte; special-token strings are ordinary
text; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow, read_documents

#: A stretch that the piece pattern never looks across: an optional space and what follows without white space, or white space.
STRETCH = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
CACHED_STRETCHES = 250_000
CACHED_PIECES = 500_000
CACHED_PAIRS = 1_000_000
CACHED_BYTES = 32


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Repeatedly merges the adjacent pair of least rank; quadratic, for short data."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if best == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.texts = {rank: str(rank) for rank in self.tokens}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def together(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            found = merge_by_rank(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def longest_match(self, text: str, start: int, most: int) -> tuple[int, int]:
        """Length and rank of the longest token of at most ``most`` bytes that stands at ``start``; (0, -1) if none does."""
        size = self.automaton.longest_prefix(text[start : start + most]) if most > 0 else 0
        while size:
            rank = self.latin.get(text[start : start + size])
            if rank is not None:
                return size, rank
            size -= 1
        return 0, -1

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        dead, path = bytearray(n + 1), []
        position, most = 0, self.longest
        while position < n:
            size, rank = self.longest_match(text, position, most)
            while size and (dead[position + size] or path and not self.together(path[-1], rank)):
                size, rank = self.longest_match(text, position, size - 1)
            if size:
                path.append(rank)
                position, most = position + size, self.longest
            else:  # nothing goes on from here: back to a shorter token before
                dead[position] = 1
                size = len(self.tokens[path.pop()])
                position, most = position - size, size - 1
        return path

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the memos keep what comes first, which is most frequent."""
        ids: list[int] = []
        known, memo, pieces = self.stretches, self.pieces, self.pattern.findall
        for stretch in STRETCH.findall(text):
            got = known.get(stretch)
            if got is None:
                got = ()
                for piece in pieces(stretch):
                    part = memo.get(piece)
                    if part is None:
                        part = tuple(self.encode_piece(piece.encode()))
                        if len(memo) < CACHED_PIECES and len(piece) <= CACHED_BYTES:
                            memo[piece] = part
                    got += part
                if len(known) < CACHED_STRETCHES and len(stretch) <= CACHED_BYTES:
                    known[stretch] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One tokenizer for each worker process."""
    return ByteBPE.from_file(path, pattern)


def map_encoded(docs: DataFrame, path: str, pattern: str, fn: Callable[[ByteBPE, list[int]], tuple], out: str) -> DataFrame:
    """doc_id and what ``fn`` makes of the ids of each text (columns ``out``); the rank file is read on each worker."""
    schema = arrow_schema(f"doc_id long, {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            rows = [(i, *fn(bpe, bpe.encode(t))) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), run, f"doc_id long, {out}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array) of every row of ``docs``."""
    return map_encoded(docs, path, pattern, lambda _, ids: (ids,), "ids array<int>")


def digests(bpe: ByteBPE, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(bpe.texts.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return map_encoded(docs, path, pattern, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_with_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and their digests."""
    return map_encoded(docs, path, pattern, lambda bpe, ids: (ids, *digests(bpe, ids)), "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
