"""Quality rules: how far a document's character-class and common-word histograms diverge from language references.

Pass 1 counts, over all documents, the character classes and all words of each language; the references are those counts'
distributions (common words: the COMMON_WORDS most frequent words of a language and the rest) of the LANGUAGES languages
with most words. Pass 2 takes each document's histograms and their Jensen-Shannon distances (base 2, 0 to 1) to every
reference; both distances are those to one language, the nearest by their sum, so a wrong language label does no harm.
Documents under the length guards are not judged by a distance, since short histograms diverge by chance alone.

Defined results: null or empty text has no words, so base_failed is true; a null language is one of its own; with no
reference (empty corpus) only the base rules hold; texts of any length are judged whole; ties (equal counts at the last
common word, equal numbers of words of languages, equally near languages) go to the first in order of bytes; repeated rows
are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow, read_documents, text_bytes
from lakelens.session import cut

#: The size of the model: words of a reference, and languages that have one.
COMMON_WORDS = 40
LANGUAGES = 256
MIN_WORDS = 100
MIN_CHARS = 400
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.40
FLUSH_KEYS = 100_000

CLASSES = ("space", "newline", "lower", "upper", "digit", "punctuation", "symbol", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[[9, 11, 12, 13, 32]], table[10] = 0, 1
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 2, 3, 4
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    table[0x80:0xC0] = 8  # continuation bytes belong to the character before
    table[0xC0:] = 7
    return table


CLASS_TABLE = _class_table()
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"

COUNTS = "lang string, kind string, item string, n long"
RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_TABLE[np.frombuffer(text, np.uint8)], minlength=9)[:8]


def count_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task; flushed at FLUSH_KEYS entries, so memory does not grow with the task's rows."""
    schema, counts = arrow_schema(COUNTS), Counter()

    def rows() -> pa.RecordBatch:
        keys, n = list(counts), list(counts.values())
        out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(n, pa.int64())], schema=schema)
        counts.clear()
        return out

    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        by_lang: dict = {}
        for lang, text in zip(langs, texts, strict=True):
            words, classes = by_lang.setdefault(lang, (Counter(), np.zeros(8, np.int64)))
            classes += class_counts(text)
            found = text.translate(FOLD).split()
            words[b""] += len(found)
            words.update(found)
        for lang, (words, classes) in by_lang.items():
            for w, n in words.items():
                counts[lang, "word" if w else "words", w.decode("utf-8", "replace")] += n
            for name, n in zip(CLASSES, classes.tolist(), strict=True):
                counts[lang, "class", name] += n
        if len(counts) > FLUSH_KEYS:
            yield rows()
    yield rows()


def language_references(docs: DataFrame) -> list[tuple]:
    """(lang, class distribution, common words, their distribution and the rest) from counts over all documents.

    What comes to the driver is COMMON_WORDS + 9 rows for each of LANGUAGES languages, however large the corpus is.
    """
    counts = map_arrow(docs.select(F.col("lang").cast("string").alias("lang"), text_bytes().alias("text")), count_language, COUNTS)
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    best = cut(counts.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= COMMON_WORDS).drop("nth"))
    largest = best.filter("kind = 'words'").orderBy(F.desc("n"), "lang").limit(LANGUAGES).select(F.col("lang").alias("of"))
    found: dict = {}
    for row in best.join(F.broadcast(largest), F.col("lang").eqNullSafe(F.col("of"))).collect():  # LANGUAGES rows at most
        found.setdefault(row["lang"], {}).setdefault(row["kind"], {})[row["item"]] = row["n"]
    out = []
    for lang in sorted(found, key=str):
        kinds = found[lang]
        total, classes = kinds.get("words", {}).get("", 0), np.array([kinds["class"].get(c, 0) for c in CLASSES], float)
        words = sorted(kinds.get("word", {}).items(), key=lambda x: (-x[1], x[0]))
        if not total or not classes.sum():
            continue
        shares = np.array([n for _, n in words] + [total - sum(n for _, n in words)], float) / total
        out.append((lang, (classes / classes.sum()).tolist(), [w.encode() for w, _ in words], shares.tolist()))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, of distributions in the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(0.0, parts.sum(axis=-1) / 2))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, CONTINUATION)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats, n = 0, len(words)
    if n >= 3:
        seen: dict = {}
        ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, n)
        size = len(seen)
        pair = ids[:-1] * size + ids[1:]
        if size < 2_000_000:
            triple = pair[:-1] * size + ids[2:]
        else:
            triple = np.unique(pair, return_inverse=True)[1][:-1] * size + ids[2:]
        _, which, count = np.unique(triple, return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


class Judge:
    """Distances of a document to its nearest reference."""

    def __init__(self, references: list[tuple]):
        self.classes = np.array([r[1] for r in references]).reshape(-1, len(CLASSES))
        self.column = {w: i for i, w in enumerate(sorted({w for r in references for w in r[2]}))}
        n = len(self.column)  # a column that stays 0 fills up references of fewer words
        self.at = np.array([[self.column[w] for w in r[2]] + [n] * (COMMON_WORDS - len(r[2])) for r in references], np.int64).reshape(-1, COMMON_WORDS)
        self.words = np.array([r[3][:-1] + [0.0] * (COMMON_WORDS + 1 - len(r[3])) + r[3][-1:] for r in references]).reshape(-1, COMMON_WORDS + 1)

    def distances(self, text: bytes) -> tuple[float, float, int]:
        """Class and word distance to the nearest reference, and the number of characters."""
        hist = class_counts(text)
        chars = int(hist.sum())
        if not chars or not len(self.classes):
            return 0.0, 0.0, chars
        by_class, by_word = js_distance(hist / chars, self.classes), np.zeros(len(self.classes))
        words = text.translate(FOLD).split()
        if words:
            counts, n = Counter(words), len(words)
            seen = np.zeros(len(self.column) + 1)
            for w in counts.keys() & self.column.keys():
                seen[self.column[w]] = counts[w]
            got = seen[self.at]
            by_word = js_distance(np.concatenate([got, n - got.sum(axis=1, keepdims=True)], axis=1) / n, self.words)
        nearest = int((by_class + by_word).argmin())
        return float(by_class[nearest]), float(by_word[nearest]), chars

    def row(self, doc_id: int | None, text: bytes) -> tuple:
        n_words, chars, symbols, dup_lines, repeats = base_counts(text)
        failed = n_words < 50 or 100 * repeats > 50 * n_words
        by_class, by_word, n_chars = self.distances(text)
        odd = n_chars >= MIN_CHARS and by_class > MAX_CLASS_DISTANCE or n_words >= MIN_WORDS and by_word > MAX_WORD_DISTANCE
        return doc_id, n_words, chars, symbols, dup_lines, repeats, failed, not failed and not odd, by_class, by_word


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of rule values and the verdict for every row of ``docs`` (columns doc_id, text, lang)."""
    references = language_references(docs)
    schema = arrow_schema(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(references)
        for batch in batches:
            rows = [judge.row(i, t) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), run, RULES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir))
