"""Operators that look at one text at a time, against brute force or the library they must equal."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakelens.llm import bpe, licences, quality_mil, quality_rules, toxicity, wavelet
from tests.conftest import SMALL, TINY

ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (None, "null id", "x"), (5, "same", "x"), (5, "same", "x"), (6, "long " * 50_000, "x"), (7, "é́ 日本 \x1c ﬁ İ!", "x")]


def odd(spark, *extra):
    docs = spark.createDataFrame([r[:2] for r in ODD], "doc_id long, text string")
    return docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("score"), F.lit("a").alias("n_words"), F.lit(2).alias("th"), *(F.lit(c).alias(c) for c in ("k", "rep", "bytes", "rest", "kept", "fp", "h")))


def texts(spark, folder=TINY):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def words_1(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_phrases(text):
    words = words_1(text)
    places = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_op1_equals_brute_force(spark):
    got = licences.op1_licence_scan(spark, SMALL).collect()
    want = texts(spark, SMALL)
    assert len(got) == len(want)
    assert all((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(want[r["doc_id"]]) for r in got)
    assert any(r["n_base"] for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_op1_random_phrases_and_spans():
    rng = random.Random(3)
    vocabulary = ["mit", "license", "apache", "general", "public", "the", "software"]
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(40))
        assert licences.scan_row(0, text.encode())[1:6] == brute_phrases(text)
    full = licences.scan_row(0, ("intro words " + licences.TEMPLATES["mpl"][0].replace("at", "at.") + " outro").encode())
    assert full[6] == "mpl" and full[7] == 1.0 and full[8] == 1


def test_op1_matches_equal_brute_force():
    """Maximal matches of four words and more, against the longest template substring that ends at each word."""
    rng = random.Random(7)
    templates = [t.split() for texts_ in licences.TEMPLATES.values() for t in texts_] + [p.split() for p in licences.BASE_PHRASES]
    grams = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(60):
        words = []
        while len(words) < 120:
            t = rng.choice(templates)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randint(1, 25)] + ["zzz"] * (rng.random() < 0.3)
        longest = [next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in grams), 0) for i in range(len(words))]
        want = [(i + 1, n) for i, n in enumerate(longest) if n >= 4 and (i + 1 == len(words) or longest[i + 1] <= n)]
        places, matches = licences.scanner().stream([w.encode() for w in words])
        assert [m[:2] for m in matches] == want


NOTICES = {
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mit": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "": "This work is licensed under the terms that we agreed on, and may be used with no more ado by all of you.",
}


@pytest.mark.parametrize("label", sorted(NOTICES))
def test_op1_competing_templates(label):
    row = dict(zip([c.split()[0] for c in licences.SCAN.split(", ")], licences.scan_row(1, f"Some words before. {NOTICES[label]} And after it.".encode()), strict=True))
    own = set(filter(None, row["labels"].split(","))) - set(row["base_labels"].split(",")) | ({label} if label == "gpl" else set())
    assert own == ({label} if label else set()) and (row["score"] > 0.5 or not label)


def test_op1_short_templates_need_their_own_words():
    assert licences.scan_row(1, b"This work is licensed under the MIT license")[6] == "mit"
    assert licences.scan_row(1, b"this work is licensed under a MIT style grant")[6] == ""


def test_op1_odd_rows(spark):
    got = licences.scan_licences(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got if r["n_words"] == 0} == {0.0}
    assert licences.scan_licences(odd(spark).filter("false")).isEmpty()


def accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", label)
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    return np.mean([r["predicted"] == r[label] for r in rows]), len(rows)


def test_op2_held_out_accuracy(spark):
    right, n = accuracy(spark, toxicity.op2_toxicity(spark, SMALL), "toxic")
    assert n > 50 and right > 0.93


def test_op7_held_out_accuracy(spark):
    right, n = accuracy(spark, quality_mil.op7_quality_mil(spark, SMALL), "quality")
    assert n > 50 and right > 0.93


def test_op2_op7_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd(spark)
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    model = quality_mil.quality_model(docs, none)
    assert [r["score"] for r in quality_mil.score_documents(docs, model).collect()] == [0.5] * len(ODD)
    assert quality_mil.keep_good(docs, model).columns == docs.columns
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert len(set(quality_mil.score_documents(docs, quality_mil.quality_model(docs, one)).select("score").collect())) == 1
    assert toxicity.score_toxicity(docs.filter("false"), none).isEmpty()


def test_op2_parts():
    knots, values = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 0.0, 1.0, 0.0]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    lexicon = toxicity.Lexicon({b"idiot": 2.0})
    row = dict(zip(toxicity.FEATURES, toxicity.features(b"You id1ot, you idiot!", lexicon), strict=True))
    assert row["hits"] == 1 and row["obfuscated_hits"] == 1 and row["near_second_person"] == 1.0


def test_op7_pieces_of_long_texts(monkeypatch):
    """Long texts give the passages that they give at once, and fitting sees all of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcDE1!,\u00e9") for _ in range(rng.randint(1, 9)))
    cases = ["", "  \n ", "x" * 3000, *(rng.choice(["", " "]) + (" " * rng.randint(1, 3)).join(word() for _ in range(rng.randint(0, 900))) for _ in range(12))]
    cases = [c.encode() for c in cases]
    x, first = quality_mil._passages(cases)
    monkeypatch.setattr(quality_mil, "PIECE", 700)
    got, at = quality_mil.passages(cases)
    assert (at == first).all() and np.allclose(got, x)


def test_op7_fits_on_all_passages(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality_mil.AttentionMIL, "fit", lambda self, x, first, y, **_: fitted.append(np.diff(first)) or self)
    rows = [(i, "word and other " * (2000 if i % 2 else 3), i % 2) for i in range(6)]
    quality_mil.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert sorted(fitted[0].tolist()) == [1, 1, 1, 94, 94, 94]


def test_samples_are_bounded_and_whole(spark):
    from lakelens.llm import labelled

    docs = spark.createDataFrame([(i, "t" * 100, 1) for i in range(40)] + [(3, "t" * 100, 1)] * 30 + [(50, "u" * 900, 1)], "doc_id long, text string, th int")
    labels = spark.createDataFrame([(i, 1) for i in range(51)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    take = lambda rows, size: labelled.training_sample(docs, labels, "toxic", F.col("doc_id") == 5, rows, size).collect()
    got = take(1000, 4000)
    assert len(got) == 39 and {r["doc_id"] for r in got} == set(range(40)) - {5} and all(len(r["text"]) == 100 for r in got)
    assert len(take(10, 1 << 20)) <= 10 and len(take(1000, 1000)) == 10 and take(1000, 700) == []


def test_samples_ignore_labels_of_other_documents(spark):
    from lakelens.llm import labelled

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    own = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    foreign = own.unionByName(spark.range(1000, 60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")))
    take = lambda labels: sorted(map(tuple, labelled.training_sample(docs, labels, "quality", labelled.remainder(3) == 1, 50).collect()))
    assert take(own) == take(foreign) and len(take(own)) == 50


def test_op7_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, 5)).astype(np.float32), np.array([0, 4, 5, 9]), np.array([1, 0, 1], np.float32)
    model = quality_mil.AttentionMIL(np.zeros(5), np.ones(5))
    model.p = {k: rng.normal(0, 0.5, v.shape) for k, v in model.p.items()}
    loss = lambda: float(-np.mean(y * np.log(model.forward(x, first)["y"]) + (1 - y) * np.log(1 - model.forward(x, first)["y"])))
    for name, grad in model.gradients(x, first, y).items():
        at = np.unravel_index(int(np.abs(grad).argmax()), grad.shape)
        before, model.p[name][at] = model.p[name][at], model.p[name][at] + 1e-4
        up = loss()
        model.p[name][at] = before - 1e-4
        slope = (up - loss()) / 2e-4
        model.p[name][at] = before
        assert abs(slope - grad[at]) < 1e-3, name


def test_op3_equals_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for i, text in sorted(texts(spark).items()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.op3_wavelet_token_ids(spark, TINY).collect()}
    assert got == want


def test_op3_encoder_on_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(1)
    cases = [r[1] or "" for r in ODD] + [" é, É. İ! ß? ǅ;", "a<|endoftext|>b <|startoftext|>", " 's 't don't I'LL", "é̂, ́a ̈ b"]
    cases += ["".join(rng.choice("abcdehilnorst \n'1.é日,!ÉÁ") for _ in range(200)) for _ in range(100)]
    cases += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(80)) for _ in range(100)]
    for _ in range(2):  # the second time from the memo
        got = [np.frombuffer(b, "<u4").tolist() for b in wavelet.load(path).encode(cases)]
        assert got == [tokenizer.encode(c, add_special_tokens=False).ids for c in cases]


def test_op3_other_tokenizers_go_to_the_library(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert wavelet.is_word_tokenizer(path)
    steps = json.load(open(path))
    steps["normalizer"] = {"type": "NFC"}
    other = f"{tmp_path}/other.json"
    json.dump(steps, open(other, "w"))
    cases = ["Some Upper Case text, twice.", "", "\u00e9 \u65e5\u672c"]
    want = [Tokenizer.from_file(other).encode(c, add_special_tokens=False).ids for c in cases]
    assert not wavelet.is_word_tokenizer(other) and [np.frombuffer(b, "<u4").tolist() for b in wavelet.load(other).encode(cases)] == want


def test_op3_odd_rows_and_small_shards(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    wavelet.write_shards(odd(spark), path, 2, f"{tmp_path}/a", shard_tokens=10)
    got = wavelet.read_shards(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert len(got) == len(ODD) and got[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    wavelet.write_shards(odd(spark).filter("false"), path, 2, f"{tmp_path}/b")
    assert wavelet.read_shards(spark, f"{tmp_path}/b").isEmpty()


@pytest.mark.parametrize("size,most", [(0, 5), (1, 1), (5000, 300), (3000, 70_000)])
def test_op3_wavelet_matrix(size, most):
    values = np.random.default_rng(size).integers(0, most, size)
    ids, lengths, matrix = wavelet.unpack(wavelet.pack([7, None], np.array([size, 0]), wavelet.WaveletMatrix.build(values)))
    assert ids == [7, None] and lengths.tolist() == [size, 0] and (matrix.values() == values).all()
    for i in range(0, size, 131):
        assert matrix.access(i) == values[i]
    for v in [*values[:3].tolist(), most + 1]:
        assert matrix.count(v, 0, size) == (values == v).sum()
        assert list(matrix.occurrences(v, size // 3, size)) == [i for i in np.flatnonzero(values == v).tolist() if i >= size // 3]


def test_op8_equals_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.ByteBPE.from_file(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    cases = [t or "" for t in texts(spark).values()] + [r[1] or "" for r in ODD] + ["a" * 20_000, "ab" * 5000, "\x1c a\x1d b\x85c d　 e\xa0f", " 's don't I'LL", "<|endoftext|>", " \t\n \r\n"]
    cases += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(100)) for _ in range(200)]
    for case in cases:
        ids = own.encode(case)
        assert ids == library.encode_ordinary(case) and own.decode(ids) == case.encode()
    assert all(own.encode_piece(t) == [r] for t, r in list(own.ranks.items())[::97])


def test_op8_query_and_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.encode_digests(odd(spark), path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) and got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts(spark).items()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in bpe.op8_byte_bpe(spark, TINY).collect()} == want
    assert bpe.encode(odd(spark).filter("false"), path, public_tokenizers.PATTERN).isEmpty()


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    repeats = len(covered)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words)


def test_op10_equals_brute_force(spark):
    want = texts(spark)
    got = quality_rules.op10_quality_rules(spark, TINY).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert len(got) == len(want) and all(tuple(r[c] for c in columns) == brute_rules(want[r["doc_id"]]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op10_keeps_good_and_drops_odd(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.op10_quality_rules(spark, SMALL).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) > 5
    got = quality_rules.quality_rules(odd(spark)).collect()
    assert len(got) == len(ODD) and all(not r["kept"] for r in got)
    assert quality_rules.quality_rules(odd(spark).filter("false")).isEmpty()


def brute_distances(text, references):
    """(class, word) distances to the reference that is nearest by their sum."""
    from collections import Counter

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return np.sqrt(max(0, part(p) + part(q)) / 2)

    kind = lambda c: 0 if c in " \t\x0b\x0c\r" else 1 if c == "\n" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 5 if c in ".,;:!?'\"()-" else 6 if c < "\x80" else 7
    chars = Counter(map(kind, text))
    words = re.findall("[a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))
    best = []
    for _, classes, common, shares in references:
        by_class = js([chars[k] / len(text) for k in range(8)], classes) if text else 0.0
        counts = [sum(w.encode() == c for w in words) for c in common]
        by_word = js([n / len(words) for n in [*counts, len(words) - sum(counts)]], shares) if words and text else 0.0
        best.append((by_class + by_word, by_class, by_word))
    return min(best)[1:] if best and text else (0.0, 0.0)


def test_op10_verdict_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    references = quality_rules.language_references(docs)
    rows = {r["doc_id"]: r for r in quality_rules.op10_quality_rules(spark, TINY).collect()}
    for i, text in [*texts(spark).items()][:60]:
        got, (by_class, by_word) = rows[i], brute_distances(text, references)
        assert abs(got["class_distance"] - by_class) < 1e-9 and abs(got["word_distance"] - by_word) < 1e-9
        odd_one = len(text) >= 400 and by_class > 0.30 or got["n_words"] >= 100 and by_word > 0.40
        assert got["kept"] == (not got["base_failed"] and not odd_one)


def test_op10_words_of_any_script_and_ties(spark):
    rows = [(1, "\u043a\u043e\u0442\u043e\u0440\u044b\u0439 \u0438 \u043a\u043e\u0442\u043e\u0440\u044b\u0439 " * 30, "ru"), (2, "\u56fe\u4e66\u9986 \u7684 \u56fe\u4e66\u9986 " * 30, "zh"), (3, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)), "xx"), (4, "alone", None)]
    found = {r[0]: r for r in quality_rules.language_references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))}
    assert found["ru"][2][0] == "\u043a\u043e\u0442\u043e\u0440\u044b\u0439".encode() and found["zh"][2][0] == "\u56fe\u4e66\u9986".encode()
    assert found["xx"][2] == sorted(found["xx"][2]) and len(found["xx"][2]) == quality_rules.COMMON_WORDS and None in found


def test_op10_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LANGUAGES", 2)
    rows = [(i, "some words here " * (i % 5 + 1), f"l{i % 5}") for i in range(50)]
    found = quality_rules.language_references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [r[0] for r in found] == ["l3", "l4"]


def test_op10_distance():
    p = np.array([0.5, 0.5, 0.0])
    assert quality_rules.js_distance(p, p) == 0 and abs(quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) - 1) < 1e-12
    assert json.dumps(quality_rules.base_counts(b"")) == "[0, 0, 0, 0, 0]"
