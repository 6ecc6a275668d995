"""Token-ID output as wavelet matrices: one compressed file per shard that answers access, count and occurrence queries.

A shard holds the ids of consecutive documents as bit planes, most significant bit first; each plane is followed by a
stable partition of the sequence by its bit. A directory of ones before every 512 bits makes rank constant-time and
select a binary search. Planes, directory and the documents' ids and lengths are packed and compressed into one blob, the
shard's file; Spark's writer stores the blobs, since only it reaches every shared store, a row for each shard.

Documents are dealt to contiguous ranges of doc_id (bounds from its quantiles), each range is sorted and cut into shards
of at most SHARD_TOKENS ids, one longer document being a shard of its own; so a worker's memory is bounded by a shard.

Defined results: null or empty text is the end id alone; null doc_ids come first; repeated doc_ids stand in the order of
their texts; an empty table gives no shard and no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow, read_documents
from lakelens.llm.sharding import range_bounds, range_index
from lakelens.session import scratch

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512
MAGIC = b"WMX1"
CACHED_WORDS = 300_000
CACHED_CHARS = 32
TAIL = string.punctuation
ENCODE_ROWS = 3000
ENCODE_CHARS = 4_000_000
MAX_RANGES = 20_000

SHARDS = "part int, seq int, n_docs long, n_tokens long, file binary"


class WaveletMatrix:
    """Succinct sequence of unsigned integers: access, rank, select, count and occurrences over bit planes."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks
        self.levels = len(planes)

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        values = values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32)
        levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        zeros, planes, ranks = [], [], []
        for level in reversed(range(levels)):
            ones = values & values.dtype.type(1 << level) != 0
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK_BITS // 8), np.uint8)])
            per_block = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.int64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))
            low = np.compress(~ones, values)
            zeros.append(len(low))
            values = np.concatenate([low, np.compress(ones, values)])
        return cls(len(values), zeros, planes, ranks)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the partitions from the last plane to the first."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            ones, z = self._bits(level), self.zeros[level]
            before = np.empty_like(out)
            before[np.flatnonzero(~ones)] = out[:z]
            before[np.flatnonzero(ones)] = out[z:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = before
        return out

    def ones_before(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        count = int(self.ranks[level][block])
        if rest:
            start = block * (BLOCK_BITS // 8)
            data = self.planes[level][start : start + -(-rest // 8)].copy()
            if rest % 8:
                data[-1] &= (1 << rest % 8) - 1
            count += int(np.bitwise_count(data).sum())
        return count

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self.ones_before(level, middle + 1)
            if (ones if bit else middle + 1 - ones) <= k:
                low = middle + 1
            else:
                high = middle
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            ones = self.ones_before(level, i)
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.ones_before(level, start), self.ones_before(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.levels - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        low, high = self._range(value, start, self.n if end is None else end)
        return high - low

    def occurrences(self, value: int, start: int = 0, end: int | None = None) -> Iterator[int]:
        low, high = self._range(value, start, self.n if end is None else end)
        for i in range(low, high):
            for level in reversed(range(self.levels)):
                bit = value >> (self.levels - 1 - level) & 1
                i = self.select(level, bit, i - self.zeros[level] if bit else i)
            yield i


def pack(doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """A shard's file: magic, then a zstandard frame of header, documents, zero counts, rank directories and planes."""
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    nulls = np.packbits(np.array([i is None for i in doc_ids], bool))
    head = struct.pack("<QIII", matrix.n, matrix.levels, len(doc_ids), len(nulls))
    body = [head, ids.tobytes(), nulls.tobytes(), lengths.astype("<i8").tobytes(), np.array(matrix.zeros, "<i8").tobytes()]
    return MAGIC + zstandard.ZstdCompressor(level=1).compress(b"".join([*body, *(r.tobytes() for r in matrix.ranks), *(p.tobytes() for p in matrix.planes)]))


def unpack(file: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix of a shard's file."""
    if file[:4] != MAGIC:
        raise ValueError("not a shard file")
    data, at = zstandard.ZstdDecompressor().decompress(file[4:]), struct.calcsize("<QIII")
    n, levels, n_docs, n_nulls = struct.unpack("<QIII", data[:at])

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype, count, at)
        at += out.nbytes
        return out

    ids, nulls = take("<i8", n_docs), np.unpackbits(take("u1", n_nulls), count=n_docs)
    lengths, zeros = take("<i8", n_docs), take("<i8", levels).tolist()
    blocks = -(-n // BLOCK_BITS)
    ranks = [take("<u4", blocks + 1) for _ in range(levels)]
    planes = [take("u1", blocks * (BLOCK_BITS // 8)) for _ in range(levels)]
    return [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], lengths, WaveletMatrix(n, zeros, planes, ranks)


class Memo:
    """Ids of known strings as columns, so that lookups of many strings are one vectorised call."""

    def __init__(self, most: int):
        self.most, self.words = most, pa.array([""], pa.large_string())
        self.begin, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def add(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Keep short new words while there is room: what comes first is most frequent."""
        if len(self.words) >= self.most or not len(words):
            return
        short = pc.less_equal(pc.utf8_length(words), CACHED_CHARS).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(short)
        begins = np.cumsum(sizes) - sizes
        kept = gather(begins[at], sizes[at], ids)
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(short))])
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes[at]) - sizes[at]])
        self.size = np.concatenate([self.size, sizes[at]])
        self.ids = np.concatenate([self.ids, kept])


def gather(begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The slices ids[begin : begin + size] one after another."""
    ends = np.cumsum(sizes)
    at = np.repeat(begins - ends + sizes, sizes)
    at += np.arange(len(at))
    return ids[at]


#: The steps of a tokenizer's file that WordEncoder stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


class WordEncoder:
    """Ids of whole texts from the tokenizers library, which is asked once for each different word.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words; a word's final
    ASCII punctuation is a run of its own after letters, and ASCII letters are lower-cased, so such words share an entry.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.cores = Memo(CACHED_WORDS), Memo(CACHED_WORDS)

    def _ask(self, words: list[str], one_run: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of each word; words that are one run for the tokenizer go in one call, cut at their last tokens."""
        if one_run and words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):
                return np.diff(ends, prepend=0), ids
        got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(map(len, got)), np.int64), np.concatenate([*got, np.zeros(0, "<u4")])

    def _of_cores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of different strings, from the memo of cores or the library."""
        found = self.cores.find(words)
        new = np.flatnonzero(found < 0)
        asked = words.take(pa.array(new))
        ascii_letters = pc.and_(pc.string_is_ascii(asked), pc.utf8_is_alpha(asked)).to_numpy(zero_copy_only=False)
        texts = asked.to_pylist()
        # letters may turn to a letter and a mark, which are not one run
        run = [bool(a) or not w.isascii() and unicodedata.normalize("NFC", w).lower().isalpha() for w, a in zip(texts, ascii_letters, strict=True)]
        order = np.argsort(~np.array(run, bool), kind="stable")
        n_run = int(sum(run))
        first = self._ask([texts[i] for i in order[:n_run]], True)
        second = self._ask([texts[i] for i in order[n_run:]], False)
        sizes, ids = np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]])
        all_ids = np.concatenate([self.cores.ids, ids])
        begin, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        old = found >= 0
        begin[old], size[old] = self.cores.begin[found[old]], self.cores.size[found[old]]
        begin[new[order]], size[new[order]] = len(self.cores.ids) + np.cumsum(sizes) - sizes, sizes
        self.cores.add(asked.take(pa.array(order)), sizes, ids)
        return size, gather(begin, size, all_ids)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of different words that the memo of words lacks."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        core = pc.utf8_rtrim(words, characters=TAIL)
        ascii_, alpha = pc.string_is_ascii(core), pc.utf8_is_alpha(core)
        cuts = pc.and_(pc.not_equal(core, words), alpha).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(cuts & ~ascii_.to_numpy(zero_copy_only=False))
        for i, c in zip(other.tolist(), core.take(pa.array(other)).to_pylist(), strict=True):
            cuts[i] = unicodedata.normalize("NFC", c).lower().isalpha()
        core = pc.if_else(pa.array(cuts), core, words)
        core = pc.if_else(pc.and_(pc.string_is_ascii(core), pc.utf8_is_alpha(core)), pc.ascii_lower(core), core)
        at = np.flatnonzero(cuts)
        lengths = pc.utf8_length(core).to_numpy()[at].tolist()
        tails = pa.array([w[n:] for w, n in zip(words.take(pa.array(at)).to_pylist(), lengths, strict=True)], pa.large_string())
        coded = pa.concat_arrays([core, tails]).dictionary_encode()
        sizes, ids = self._of_cores(coded.dictionary)
        begins, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        # each word's core, then its tail: two slices, of which the second may be empty
        begin, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        begin[:, 0], size[:, 0] = begins[index[: len(words)]], sizes[index[: len(words)]]
        begin[at, 1], size[at, 1] = begins[index[len(words) :]], sizes[index[len(words) :]]
        return size.sum(axis=1), gather(begin.ravel(), size.ravel(), ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = words.values.dictionary_encode()
        found = self.words.find(coded.dictionary)
        new = np.flatnonzero(found < 0)
        unknown = coded.dictionary.take(pa.array(new))
        sizes, ids = self._learn(unknown)
        all_ids = np.concatenate([self.words.ids, ids])
        begin, size = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        old = found >= 0
        begin[old], size[old] = self.words.begin[found[old]], self.words.size[found[old]]
        begin[new], size[new] = len(self.words.ids) + np.cumsum(sizes) - sizes, sizes
        self.words.add(unknown, sizes, ids)
        index = coded.indices.to_numpy()
        data = gather(begin[index], size[index], all_ids).tobytes()
        ends = np.concatenate(([0], np.cumsum(size[index])))
        cuts = (ends[words.offsets.to_numpy()] * 4).tolist()
        return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class LibraryEncoder:
    """The same from the library alone, for tokenizers that are not of the kind a WordEncoder knows."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def is_word_tokenizer(path: str) -> bool:
    """Whether the file's steps are those that WordEncoder stands for."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    model = steps["model"]
    plain = all(model.get(k) == v for k, v in (("type", "BPE"), ("dropout", None), ("continuing_subword_prefix", None), ("end_of_word_suffix", "</w>")))
    return plain and steps["normalizer"] == NORMALIZER and steps["pre_tokenizer"] == PRE_TOKENIZER and steps["truncation"] is None


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordEncoder | LibraryEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path) if is_word_tokenizer(path) else LibraryEncoder(path)


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every row of ``docs`` (doc_id, text) and write the shards' files to ``folder`` in ascending doc_id order."""
    spark, schema = docs.sparkSession, arrow_schema(SHARDS)
    bounds = range_bounds(docs, min(MAX_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = range_index("doc_id", bounds).cast("int")
    rows = rows.withColumn("part", part).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        held: list[tuple[int | None, bytes]] = []
        size, seq, at = 0, 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal size, seq
            lengths = np.array([len(b) // 4 for _, b in held])
            ids = np.frombuffer(b"".join([b for _, b in held]), "<u4")
            file = pack([i for i, _ in held], lengths, WaveletMatrix.build(ids))
            out = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((at, seq, len(held), len(ids), file), schema, strict=True)], schema=schema)
            held.clear()
            size, seq = 0, seq + 1
            return out

        def gathered() -> Iterator[tuple[list, list[str]]]:
            nonlocal at
            ids, texts, chars = [], [], 0
            for batch in batches:
                more, parts = batch.column(1).to_pylist(), batch.column(2)
                at = parts[0].as_py() if len(more) else at
                ids += batch.column(0).to_pylist()
                texts += more
                chars += sum(map(len, more))
                if len(texts) >= ENCODE_ROWS or chars >= ENCODE_CHARS:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
            yield ids, texts

        for ids, texts in gathered():
            encoded = encoder.encode(texts)
            pa.default_memory_pool().release_unused()  # else a worker keeps the most that any batch took
            for i, b in zip(ids, encoded, strict=True):
                b += end
                if held and size + len(b) // 4 > shard_tokens:
                    yield shard()
                held.append((i, b))
                size += len(b) // 4
        if held:
            yield shard()

    map_arrow(rows, run, SHARDS).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' files in ``folder``."""
    shards = spark.read.parquet(folder)
    sizes = shards.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))  # a row for each range
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("within")).alias("shard_start"))
    out = "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, matrix = unpack(batch.column(2)[row].as_py())
                data, ends = matrix.values().astype("<u4").tobytes(), np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                columns = ([batch.column(0)[row].as_py()] * n, [batch.column(1)[row].as_py()] * n, doc_ids, begins, lengths, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = map_arrow(shards.select("part", "seq", "file"), run, out)
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op3_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch(spark, 'token-shards')}/shards"
    write_shards(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return read_shards(spark, folder)
