"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE_WORDS words. A passage is encoded by shares of character classes, word-length
and repetition statistics and a hashed histogram of its words, through a learned tanh layer. Gated attention gives each
passage a weight learned from document labels only; the weighted sum of the encodings is scored. Fitting takes all
passages of a bounded sample of labelled documents (TRAIN_DOCUMENTS rows, ``labelled.SAMPLE_BYTES`` bytes); scoring takes
every passage of every document, and the model broadcast is a few kilobytes whatever the corpus.

Defined results: null or empty text is one passage of zero features; texts of any length are encoded in pieces of PIECE
bytes, as if whole; with no usable labels, or one class only, the score is the labels' mean, or 0.5; a score of exactly
0.5 counts as good; repeated rows give equal rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, keeps_columns, map_arrow, read_documents, text_bytes
from lakelens.llm.labelled import read_labels, remainder, training_sample

PASSAGE_WORDS = 64
BUCKETS = 64
TRAIN_DOCUMENTS = 4000
PIECE = 1 << 20
HIDDEN = 16
ATTENTION = 8
EPOCHS = 200
FEATURES = 16 + BUCKETS

SCORES = "doc_id long, score double"


def _classes() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    table[0x80:] = 6
    table[ord("!")] = 7
    return table


CLASS = _classes()
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def first_words(text: bytes, at: int, words: int) -> int:
    """Where in ``text`` the word begins that has ``words`` words before it since ``at``; the end if there is none."""
    size = PIECE
    while True:
        space = CLASS[np.frombuffer(text[at : at + size], np.uint8)] == 0
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if len(begins) > words:
            return at + int(begins[(len(begins) - 1) // words * words])
        if at + size >= len(text):
            return len(text)
        size *= 2


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and bytes of texts, about PIECE bytes at a time; a longer text is cut where a passage begins."""
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text) if len(text) - at <= PIECE else first_words(text, at, PASSAGE_WORDS)
            numbers.append(i)
            held.append(text[at:end])
            size += end - at
            if size >= PIECE:
                yield numbers, held
                numbers, held, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if held:
        yield numbers, held


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of ``texts``, and each text's first passage (with the end appended)."""
    found, counts = [np.zeros((0, FEATURES), np.float32)], np.zeros(len(texts), np.int64)
    for numbers, held in pieces(texts):
        x, first = _passages(held)
        found.append(x)
        np.add.at(counts, numbers, np.diff(first))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(counts)))


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts) + b"\n" + bytes(8)
    raw = np.frombuffer(joined, np.uint8)[:-8]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    kinds = CLASS[raw]
    space = kinds == 0
    after = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & after), np.flatnonzero(space & ~after)
    of_text = np.searchsorted(text_ends, starts, side="right")
    n_words = np.bincount(of_text, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(n_passages)))
    nth = np.arange(len(starts)) - np.concatenate(([0], np.cumsum(n_words)))[of_text]
    passage = first[of_text] + nth // PASSAGE_WORDS
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        out[:, 0] = np.diff(text_ends, prepend=0) > 1  # white space alone
        return out, first
    sizes = ends - starts
    words = np.bincount(passage, minlength=total)
    safe = np.maximum(1, words)
    folded = np.frombuffer(joined.translate(FOLD), np.uint8)
    eight = np.ndarray(len(raw) + 1, "<u8", folded.data, 0, (1,))[starts] & MASKS[np.minimum(sizes, 8)]
    hashes = (eight ^ (sizes.astype(np.uint64) << np.uint64(59))) * np.uint64(0x9E3779B97F4A7C15)
    # character classes by passage: bytes belong to the passage of the last word begun in their text, else to its first
    of_byte = np.repeat(np.arange(len(texts)), np.diff(text_ends, prepend=0))
    begun = np.cumsum(~space & after) - np.concatenate(([0], np.cumsum(n_words)))[of_byte]
    owner = first[of_byte] + np.maximum(0, begun - 1) // PASSAGE_WORDS
    kinds = kinds.copy()
    kinds[text_ends - 1] = 8  # the line feeds put between texts
    chars = np.bincount(owner * 9 + kinds, minlength=total * 9).reshape(total, 9)[:, :8]
    out[:, :8] = chars / np.maximum(1, chars.sum(axis=1, keepdims=True))
    out[:, 8] = np.bincount(passage, sizes, total) / safe / 10
    out[:, 9] = np.sqrt(np.maximum(0, np.bincount(passage, sizes.astype(float) ** 2, total) / safe - (out[:, 8] * 10) ** 2)) / 10
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])))
    out[:, 10] = np.bincount(passage, same, total) / safe
    order = np.lexsort((hashes, passage))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    out[:, 11] = np.bincount(passage[order], new, total) / safe
    lone = (sizes == 1) & np.isin(kinds[starts], (4, 5, 7))
    out[:, 12] = np.bincount(passage, lone, total) / safe
    out[:, 13] = np.bincount(passage, kinds[starts] == 2, total) / safe
    last = kinds[ends - 1]
    out[:, 14] = np.bincount(passage, (last == 5) | (last == 7), total) / safe
    out[:, 15] = np.minimum(1, words / PASSAGE_WORDS)
    buckets = np.bincount(passage * BUCKETS + (hashes >> np.uint64(58)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, 16:] = buckets / np.maximum(1, np.sqrt((buckets**2).sum(axis=1, keepdims=True)))
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMIL:
    """p = sigmoid(c.z + c0), z = sum of a_k h_k, a = softmax of w.(tanh(V h) * sigmoid(U h)), h = tanh(W x + b)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.p = {"W": rng.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": np.zeros(HIDDEN), "c0": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, at = self.p, first[:-1]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, first)
        d = ((f["y"] - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4) -> AttentionMIL:
        x = (x - self.mean) / self.scale
        prior = float(np.clip(y.mean(), 0.01, 0.99))
        self.p["c0"][:] = np.log(prior / (1 - prior))
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, epochs + 1):
            for k, g in self.gradients(x, first, y).items():
                g = g + decay * self.p[k] * (k != "c0")
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, first)["y"].astype(float)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.value)


def train(sample: DataFrame) -> AttentionMIL | Constant:
    """A model from a bounded sample (doc_id, text, y); only passage features come to the driver."""
    out = "y int, n int, features binary"
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys = (c.to_pylist() for c in batch.columns)
            x, first = passages(texts)
            rows = [(ys[k], int(first[k + 1] - first[k]), x[first[k] : first[k + 1]].tobytes()) for k in range(len(texts))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = sorted(map_arrow(sample.select(text_bytes().alias("text"), "y"), run, out).collect(), key=lambda r: (bytes(r["features"]), r["y"]))
    y = np.array([r["y"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in rows), np.float32).reshape(-1, FEATURES)
    first = np.concatenate(([0], np.cumsum([r["n"] for r in rows])))
    return AttentionMIL(x.mean(axis=0), x.std(axis=0) + 1e-3).fit(x, first, y)


def score_documents(docs: DataFrame, model: AttentionMIL | Constant, *columns: str) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    schema = arrow_schema(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            scores = model.score(*passages(texts)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), run, SCORES)


@keeps_columns
def keep_good(docs: DataFrame, model: AttentionMIL | Constant, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
                yield batch.filter(pa.array(model.score(*passages(texts)) >= least))

    return map_arrow(docs, run, docs.schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> AttentionMIL | Constant:
    return train(training_sample(docs, labels, "quality", remainder(3) == 1, TRAIN_DOCUMENTS))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    scored = score_documents(docs, quality_model(docs, read_labels(spark, sf_dir)))
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
