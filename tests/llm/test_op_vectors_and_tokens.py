"""Whitening, packing and cross-tokenizer alignment, against brute force."""

import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakelens.llm import alignment, packing, whitening
from tests.conftest import SMALL, TINY
from tests.llm.test_op_texts import ODD, odd, texts

A, B, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


def brute_whitening(vectors, k=4):
    """n, deviation of each row, eigenvalues and whitened rows up to sign, in numpy on one machine."""
    xs = [[int(np.floor(256.0 * float(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, xs))), dtype=np.int64)
    n, s = len(fit), [int(t) for t in fit.sum(axis=0)]
    centred = fit - np.array(s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    deviation = [sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)) for x in xs]
    return n, deviation, values[order][:k], values.sum(), (np.array(xs) - np.array(s) / n) @ vectors[:, order][:, :k] / np.sqrt(values[order][:k])


@pytest.mark.parametrize("folder", [TINY, SMALL])
def test_op11_equals_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    n, deviation, values, trace, whitened = brute_whitening([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in whitening.op11_jacobi_whitening(spark, folder).collect()}
    assert len(got) == 4 * len(rows)
    for k in range(4):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in rows])
        sign = np.sign(mine @ whitened[:, k])
        assert np.abs(mine * sign - whitened[:, k]).max() < 1e-8
        one = got[rows[0]["vec_id"], k + 1]
        assert one["n"] == n and abs(one["explained"] * trace / values[k] - 1) < 1e-10 and one["identity_error"] < 1e-9
    assert [got[r["vec_id"], 1]["deviation"] for r in rows] == deviation


def test_op11_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 1.0, -2.0]), (2, None), (3, [1.0, None, 0.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 1.0]), (6, [0.25, 0.0, 7.0]), (6, [0.25, 0.0, 7.0]), (None, [1.5, -0.0, 3.0]), (8, [2.0]), (9, []), (10, [-inf, 1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("c", F.lit("a")).withColumn("component", F.lit(0))
    got = whitening.whiten(docs).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 3, 6: 6, None: 3, 8: 3, 9: 3} and {r["n"] for r in got} == {5}
    n, deviation, *_ = brute_whitening([[0.5, 1.0, -2.0], [0.25, 0.0, 7.0], [1.5, 0.0, 3.0], [2.0, 0, 0], [0.0] * 3], 3)
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(zip([1, 6, None, 8, 9], deviation, strict=True))
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and all(r["whitened"] == 0 and r["explained"] == 0 and r["n"] == 1 and r["deviation"] == 0 for r in same)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [4e15, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and all(np.isfinite(r["whitened"]) for r in huge) and any(r["deviation"] is None for r in huge)
    assert whitening.whiten(docs.filter("false")).isEmpty() and whitening.whiten(docs.filter("vec_id = 9")).isEmpty()


def test_op11_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(0)
    scales = 10.0 ** -np.arange(0, 12, 1.5)
    x = rng.normal(size=(400, 8)) * scales
    values, vectors = whitening.jacobi(x.T @ x)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    assert np.abs(values / want - 1).max() < 1e-9
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    v = rng.normal(size=(30, 30))
    values, vectors = whitening.jacobi(v + v.T)
    assert np.abs((v + v.T) @ vectors - vectors * values).max() < 1e-12 and (np.diff(values) <= 0).all()


def test_op11_adds_matrices_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    fit_list = whitening.integer_vectors(frame).select("x")
    x = np.floor(256 * np.array([v for _, v in rows]))
    assert np.abs(whitening.covariance(fit_list, whitening.fit_sums(fit_list)) - np.cov(x.T, bias=True)).max() < 1e-8


def ids_of(text, end=1):
    tokenizer = ids_of.__dict__.setdefault("tokenizer", Tokenizer.from_file(WORDS))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def holds(pieces, limits):
    """Every sequence is gapless from 0 and within the limits."""
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
    sizes = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and len(rows) <= limits.segments and sum(r["n_loss"] for r in rows) <= limits.loss
        sizes.append(at)
    return sizes


def test_op12_pieces_are_the_documents(spark):
    got = packing.op12_vector_packing(spark, TINY).collect()
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
    want = {i: np.array(ids_of(t), "<u4") for i, t in texts(spark).items()}
    assert of.keys() == want.keys()
    for i, rows in of.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[i])
            assert r["ids_crc32"] == zlib.crc32(want[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[i])
    sizes = holds(got, packing.Limits())
    assert sum(2048 - n for n in sizes if n & (n - 1)) == 0 and len(sizes) < sum(sizes) / 2048 + 12 * 8


@pytest.mark.parametrize("cut", [True, False])
def test_op12_limits_bind_together(cut):
    rng = np.random.default_rng(4)
    limits, want = packing.Limits(64, 5, 40), {}
    packer, sequences = packing.Packer(limits, cut, pool=30), []
    for key in range(500):
        n = int(rng.integers(1, 30 if key % 50 else 400))
        want[key] = (rng.integers(0, 999, n).astype("<u4"), rng.random(n) < rng.random())
        sequences += packer.add(packing.Piece(key, 0, *want[key], n))
    sequences += packer.packed()
    back, whole = defaultdict(dict), 0
    for s in sequences:
        n, loss = sum(len(p.ids) for p in s), sum(int(p.bears.sum()) for p in s)
        assert n <= 64 and len(s) <= 5 and loss <= 40 and (not cut or n == 64 or n & (n - 1) == 0)
        whole += n
        for p in s:
            back[p.key][p.start] = p
    for key, (ids, bears) in want.items():
        parts = [back[key][k] for k in sorted(back[key])]
        assert np.concatenate([p.ids for p in parts]).tolist() == ids.tolist() and np.concatenate([p.bears for p in parts]).tolist() == bears.tolist()
        assert [p.start for p in parts] == np.cumsum([0, *(len(p.ids) for p in parts[:-1])]).tolist()
        assert cut or len(ids) > 40 or len(parts) == 1
    assert cut or whole / len(sequences) > 0.6 * 64  # whole examples, whose loss and number bind first


def test_op12_takes_the_greatest_product():
    packer = packing.Packer(packing.Limits(10, 4, 10), cut=False)
    piece = lambda key, n, loss: packing.Piece(key, 0, np.zeros(n, "<u4"), np.arange(n) < loss, n)
    for p in (piece(0, 3, 3), piece(1, 7, 0), piece(2, 5, 5), piece(3, 4, 4)):
        list(packer.add(p))
    # 5 tokens and 5 of loss have the greatest product; of what then fits, 4 and 4 have it
    assert [[p.key for p in s] for s in packer.packed()] == [[2, 3], [1, 0]]


def test_op12_odd_rows_and_conversations(spark):
    got = packing.pack_examples(packing.documents_as_examples(odd(spark)), WORDS, 1).collect()
    holds(got, packing.Limits())
    assert Counter(r["key"] for r in got if r["start"] == 0) == Counter(r[0] for r in ODD)
    assert sum(r["length"] for r in got) == sum(len(ids_of(r[1])) for r in ODD)
    assert packing.pack_examples(packing.documents_as_examples(odd(spark).filter("false")), WORDS, 1).isEmpty()
    with pytest.raises(ValueError, match="positive"):
        packing.Packer(packing.Limits(loss=0))
    turns = spark.read.parquet(f"{TINY}/conversations.parquet")
    limits = packing.Limits(1024, 8, 500)
    pieces = packing.pack_examples(packing.conversations_as_examples(turns), WORDS, 1, limits, cut=False)
    rows = pieces.collect()
    holds(rows, limits)
    want, bears = defaultdict(list), defaultdict(int)
    for r in turns.orderBy("conv_id", "turn").collect():
        ids = ids_of(r["text"])[:-1]
        want[r["conv_id"]] += ids
        bears[r["conv_id"]] += len(ids) * (r["role"] == "assistant")
    last = {r["conv_id"]: r["role"] == "assistant" for r in turns.orderBy("turn").collect()}
    found = defaultdict(lambda: [b"", 0])
    for r in sorted(rows, key=lambda r: r["start"]):
        found[r["key"]][0] += r["ids"]
        found[r["key"]][1] += r["n_loss"]
    assert {k: (np.frombuffer(v[0], "<u4").tolist(), v[1]) for k, v in found.items()} == {k: ([*v, 1], bears[k] + last[k]) for k, v in want.items()}
    whole = packing.whole_sequences(pieces).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in rows) and all(len(r["segments"]) <= 8 for r in whole)


def brute_alignment(rows):
    """The contract's columns of (doc_id, text) rows from whole encodings, all overlaps by comparing all ranges."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = alignment.byte_level()
    spell = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in rows:
        x, y = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
        xb, yb = [spell(i) for i in x], [piece(i) for i in y]
        if not text or not b"".join(xb) == b"".join(yb) == f" {text}".encode():
            found.append((doc_id, None))
            continue
        xe, ye = np.cumsum([len(t) for t in xb]), np.cumsum([len(t) for t in yb])
        xs, ys = xe - [len(t) for t in xb], ye - [len(t) for t in yb]
        links = [(x[i], y[j]) for i in range(len(x)) for j in np.flatnonzero((ys < xe[i]) & (ye > xs[i])).tolist()]
        counts.update(links)
        both = sorted(set(xe.tolist()) & set(ye.tolist()))
        sides = [[[] for _ in both], [[] for _ in both]]
        for side, ids, ends in zip(sides, (x, y), (xe, ye), strict=True):
            for i, end in zip(ids, ends.tolist(), strict=True):
                side[bisect_left(both, end)].append(str(i))
        parts = [f"{','.join(p)}|{','.join(q)}" for p, q in zip(*sides, strict=True)]
        found.append((doc_id, (len(x), len(y), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest())))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(i, *(0,) * 6, "") if f is None else (i, *f[:3], len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for i, f in found]


def odd_texts():
    rng = random.Random(5)
    rows = ["", None, " ", "  two  spaces ", "a▁b and more", "\n \n\n x\n  y", "<s> </s> <unk> <|endoftext|> <0x0A>", "é́ 日本語 \U0001f600\U0001f600  x", "tab\tand\r\nlines", "a\x00b\x1c c", "x" * 3000, "don't I'LL 12345 67"]
    rows += ["".join(rng.choice(" \n\tabcdefgh.,1é日▁​\x1c᠎") for _ in range(40)) for _ in range(60)]
    rows += ["".join(rng.choice(["the ", "cat", " sat", "é", "\U0001f600", "..", " "]) for _ in range(60)) for _ in range(40)]
    return list(enumerate(rows))


@pytest.mark.parametrize("held", [None, 40])
def test_op13_equals_brute_force(spark, monkeypatch, held):
    rows = odd_texts() + [(None, "null id"), (3, "  two  spaces ")]
    monkeypatch.setattr(alignment, "TAKEN_CHARS", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("row", F.lit("x")).withColumn("key", F.lit(1)).withColumn("a", F.lit(1))
    got = alignment.align_documents(docs, A, B, held).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_alignment(rows)))


def test_op13_query(spark):
    want = brute_alignment([*texts(spark).items()])
    got = alignment.op13_cross_tokenizer_alignment(spark, TINY).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r[4] for r in want) > 10_000


def test_op13_empty_tables_and_forgetful_workers(spark, monkeypatch):
    assert alignment.align_documents(odd(spark).filter("false"), A, B).isEmpty()
    got = alignment.align_documents(odd(spark), A, B).collect()
    assert len(got) == len(ODD) and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r["doc_id"] in (1, 2))
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    new, found = aligner.learn(["a", "b"], [2, 2])
    assert set(aligner.known) == set(new) == {"a", "b"} and found.sizes[:, 0].tolist() == [1, 1]
    assert aligner.settle(new, found) == 0 and not aligner.known
    monkeypatch.setattr(alignment, "REMEMBERED", 1)
    assert aligner.settle(*aligner.learn(["a", "b"], [2, 2])) == 1 and len(aligner.known) == len(aligner.memo.shown) == 1
    monkeypatch.setattr(alignment, "REMEMBERED", 4)
    assert aligner.settle(*aligner.learn(["c", "d", "e" * 99, "f"], [1, 2, 3, 1])) == 2 and {"d", "c"} < set(aligner.known) and len(aligner.known) == 3


def test_op13_no_cut_after_a_texts_last_white_space(spark):
    """Stretches that end their texts, alike in all but what is encoded after them, beside ones that B would merge with them."""
    ends = ["", " ", "  ", "\n", "\n ", "\t", "\u200b", "\u2004 ", "\u3000"]
    rows = list(enumerate(x for e in ends for w in ("--", "\u65e5\u672c", "'s", "\u0639", "<unk>", "123") for x in (f"{w}{e}", f"a{e} {w}", e)))
    got = alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B).collect()
    assert sorted(map(tuple, got)) == sorted(brute_alignment(rows))


def test_op13_index_equals_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        total = rng.randint(1, 30)
        cuts = [[0, *sorted(rng.sample(range(1, total), rng.randint(0, total - 1))), total] for _ in range(2)]
        a, b = ([q - p for p, q in zip(c, c[1:], strict=False)] for c in cuts)
        first, end, spanned = alignment.align(np.array(a), np.array(b))
        ends = lambda s: np.cumsum(s).tolist()
        ranges = lambda s: [(e - n, e) for n, e in zip(s, ends(s), strict=True)]
        assert [list(range(p, q)) for p, q in zip(first, end, strict=True)] == [[j for j, (p, q) in enumerate(ranges(b)) if p < e and q > s] for s, e in ranges(a)]
        assert [e for e, s in zip(ends(b), spanned, strict=True) if not s] == sorted(set(ends(a)) & set(ends(b)))
