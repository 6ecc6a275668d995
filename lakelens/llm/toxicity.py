"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon (a short fixed list, and words and word beginnings learned from the training labels),
how many hits stand near a second-person word, capitals, punctuation and obfuscation rates (digits or symbols written for
letters, masked letters). Trees and calibration are fitted on the driver from a bounded sample (TRAIN_DOCUMENTS rows,
``labelled.SAMPLE_BYTES`` bytes) of feature rows; only those rows and the learned entries come to the driver. The entries
are part of the model's size: the LEARNED_ENTRIES of greatest odds that enough documents show. The isotonic step is fitted
on margins out of fold, for which lexicon and trees are learned from the other folds alone. Every whole text is scored
where it is read.

Defined results: null or empty text has zero features and gets the score those give; texts of any length are scored
whole; with no usable labels, or one class only, the score is the labels' mean, or 0.5; ties (equal odds at the last
learned entry) go to the first in order of bytes, equal features get equal scores, and a score of exactly 0.5 counts as
toxic; repeated rows give equal rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow, read_documents, text_bytes
from lakelens.llm.labelled import read_labels, remainder, training_sample
from lakelens.session import cut

TRAIN_DOCUMENTS = 8000
LEARNED_ENTRIES = 256
MIN_DOCUMENTS = 6
MIN_ODDS, MIN_Z = 2.5, 4.0
STEMS = (5, 6, 7, 8)
STRONG_WEIGHT = 4.0
REMEMBERED_WORDS = 300_000
NEAR_WORDS = 4
FOLDS = 4
ROUNDS, DEPTH, RATE, BINS, MIN_LEAF = 80, 3, 0.15, 32, 20

LEXICON = "idiot idiots moron stupid dumb fool trash garbage worthless pathetic loser losers clown disgusting scum vermin hate ugly shut kill freak creep jerk coward liar".split()
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tus ti".split())

_SPLIT = {c: 32 for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90)}
PLAIN = bytes(_SPLIT.get(c, c + 32 if 65 <= c <= 90 else c) for c in range(256))
_LEET = {ord(a): ord(b) for a, b in zip("01345789@$", "oieastbgas", strict=True)}
LEET = bytes(_LEET.get(c, _SPLIT.get(c, c + 32 if 65 <= c <= 90 else c)) for c in range(256))
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, STRONG, SYMBOLS = b"0123456789", b"!?", b"#*$%&|<>@_~^"
MARKS = b".,;:!?'\"()-"

FEATURES = ("log_words", "hits", "hit_density", "distinct_hits", "weight_density", "near_second_person", "second_person", "obfuscated_hits", "masked_words", "capitals", "shouted_words", "strong_marks", "marks", "digits", "symbols", "densest_window", "largest_weight", "strong_hit_density")


class Lexicon:
    """Weights of words and, under a leading space, of word beginnings; a word has the largest that fits it."""

    def __init__(self, entries: dict[bytes, float]):
        self.entries, self.known = entries, {}

    def __reduce__(self) -> tuple:
        return Lexicon, (self.entries,)

    def weights(self, words: list[bytes]) -> list[float]:
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = max(self.entries.get(word, 0.0), *(self.entries.get(b" " + word[:k], 0.0) for k in STEMS if len(word) >= k), 0.0)
        return [known[word] for word in words]


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    """Values of FEATURES."""
    words = text.translate(PLAIN).split()
    n, size = len(words), max(1, len(text))
    weights = lexicon.weights(words)
    hits = [i for i, w in enumerate(weights) if w]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = densest = 0
    if hits:
        at = np.array(hits)
        densest = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
        if persons:
            to = np.array([-(1 << 40), *persons, 1 << 40])
            k = np.searchsorted(to, at)
            near = int((np.minimum(to[k] - at, at - to[k - 1]) <= NEAR_WORDS).sum())
    obfuscated = sum(map(bool, lexicon.weights(text.translate(LEET).split()))) - len(hits) if len(text) != len(text.translate(None, DIGITS + b"@$")) else 0
    masked = sum(0 < w.find(b"*") < len(w) - 1 for w in text.split()) if b"*" in text else 0
    count = lambda chars: len(text) - len(text.translate(None, chars))
    upper, lower = count(UPPER), count(LOWER)
    shouted = sum(w.isupper() and len(w) > 1 for w in text.split()) if upper * 4 > lower else 0
    found, m = {words[i] for i in hits}, max(1, n)
    return [float(np.log1p(n)), min(len(hits), 50), len(hits) / m, len(found), sum(weights) / m, near / max(1, len(hits)), len(persons) / m, max(0, obfuscated), masked / m, upper / max(1, upper + lower), shouted / m, count(STRONG) / size, count(MARKS) / size, count(DIGITS) / size, count(SYMBOLS) / size, densest, max(weights, default=0.0), sum(w > STRONG_WEIGHT for w in weights) / m]


class Boosted:
    """Depth-limited regression trees on quantile bins for the logistic loss, as flat arrays of features and cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS):
        self.cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.trees = np.log(prior / (1 - prior)), []
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]

    def _grow(self, bins: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        n, n_features = bins.shape
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS, np.int64)
        for depth in range(DEPTH):
            width = 1 << depth
            best = np.full(width, 1e-6)
            for f in range(n_features):
                key = node * BINS + bins[:, f]
                g, h, c = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (grad, hess, np.ones(n)))
                total = [a[:, -1:] for a in (g, h, c)]
                gain = g**2 / (h + 1) + (total[0] - g) ** 2 / (total[1] - h + 1) - total[0] ** 2 / (total[1] + 1)
                gain[(c < MIN_LEAF) | (total[2] - c < MIN_LEAF)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                feature[width - 1 + better], cut[width - 1 + better] = f, at[better]
            own = width - 1 + node
            node = node * 2 + (bins[np.arange(n), feature[own]] > cut[own])
        g, h = np.bincount(node, grad, 1 << DEPTH), np.bincount(node, hess, 1 << DEPTH)
        return (feature, cut, RATE * g / (h + 1)), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for depth in range(DEPTH):
                own = (1 << depth) - 1 + node
                node = node * 2 + (bins[rows, feature[own]] > cut[own])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: ascending x and the non-decreasing value at each."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        blocks.append([yi, 1, xi, xi])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    return knots, np.array([v for b in blocks for v in (b[0], b[0])])


class Calibrated:
    """Boosted trees whose margins are mapped to frequencies; a thousandth of the raw score keeps order inside steps.

    ``features`` has the rows' features under the lexicon learned without each fold, and last under that of all rows.
    """

    def __init__(self, features: list[np.ndarray], y: np.ndarray, fold: np.ndarray):
        out = np.zeros(len(y))
        for k, x in enumerate(features[:-1]):
            if (fold == k).any() and (fold != k).any():
                out[fold == k] = Boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots, self.values = isotonic(out, y)
        self.trees = Boosted(features[-1], y)

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        return 0.999 * np.interp(margin, self.knots, self.values) + 0.001 / (1 + np.exp(-margin))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """The fixed list, and the words and word beginnings of the sample most told apart by the labels, with log odds.

    One lexicon from the rows outside each fold, and last one from all rows.
    """
    out = "word binary, fold int, bad long, n long"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, n = Counter(), Counter()
            for text, fold, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(text.translate(PLAIN).split())
                words |= {b" " + w[:k] for w in words for k in STEMS if len(w) >= k}
                words.add(b"")
                n.update((w, fold) for w in words)
                if y:
                    bad.update((w, fold) for w in words)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.binary()), pa.array([f for _, f in n], pa.int32()), pa.array([bad[w] for w in n], pa.int64()), pa.array(list(n.values()), pa.int64())], schema=schema)

    left_out = [F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("fold") != k, F.col("bad")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0)).alias("n")) for k in range(FOLDS + 1)]
    counts = map_arrow(sample.select(text_bytes().alias("text"), fold_of(F.col("doc_id")).alias("fold"), "y"), run, out).groupBy("word").agg(F.array(*left_out).alias("x"))
    counts = cut(counts.select("word", F.explode("x").alias("x")).select("word", "x.*").filter((F.col("n") >= MIN_DOCUMENTS) | (F.col("word") == F.lit(b""))))
    entries = [{w.encode(): 2.0 for w in LEXICON} for _ in range(FOLDS + 1)]
    totals = counts.filter((F.col("word") == F.lit(b"")) & (F.col("bad") > 0) & (F.col("bad") < F.col("n")))
    totals = totals.select("k", F.col("bad").alias("all_bad"), (F.col("n") - F.col("bad")).alias("all_good"))  # a row a fold
    a, b = F.col("bad"), F.col("n") - F.col("bad")
    odds = F.log((a + 0.5) / (F.col("all_bad") - a + 0.5)) - F.log((b + 0.5) / (F.col("all_good") - b + 0.5))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    ranked = counts.filter(F.length("word") >= 3).join(F.broadcast(totals), "k").select("k", "word", odds.alias("odds"), (odds / error).alias("z")).filter(f"z > {MIN_Z} and odds > {MIN_ODDS}")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("odds"), "word"))).filter(F.col("nth") <= LEARNED_ENTRIES)
    for row in ranked.collect():  # LEARNED_ENTRIES rows a fold at most
        entries[row["k"]][bytes(row["word"])] = float(row["odds"])
    return [Lexicon(e) for e in entries]


def training_features(sample: DataFrame, lexicons: list[Lexicon]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of the sample's rows under each lexicon, labels and folds, in an order of their own."""
    out = "fold int, y int, features binary"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds, ys = (c.to_pylist() for c in batch.columns)
            rows = [np.array([features(t, x) for x in lexicons]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(ys, pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    rows = map_arrow(sample.select(text_bytes().alias("text"), fold_of(F.col("doc_id")).alias("fold"), "y"), run, out).collect()
    rows = sorted((bytes(r["features"]), r["fold"], r["y"]) for r in rows)
    x = np.array([np.frombuffer(r[0]) for r in rows]).reshape(len(rows), len(lexicons), len(FEATURES))
    return [x[:, k] for k in range(len(lexicons))], np.array([r[2] for r in rows], float), np.array([r[1] for r in rows], int)


def map_scores(docs: DataFrame, lexicon: Lexicon, model: Calibrated | Constant) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    out = "doc_id long, score double"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), run, out)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, Calibrated | Constant]:
    sample = cut(training_sample(docs, labels, "toxic", remainder(5) == 0, TRAIN_DOCUMENTS))
    lexicons = learn_lexicons(sample)
    x, y, fold = training_features(sample, lexicons)
    if not len(y) or y.min() == y.max():
        return lexicons[-1], Constant(float(y.mean()) if len(y) else 0.5)
    return lexicons[-1], Calibrated(x, y, fold)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    lexicon, model = toxicity_model(docs, labels)
    return map_scores(docs, lexicon, model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read_documents(spark, sf_dir), read_labels(spark, sf_dir))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
