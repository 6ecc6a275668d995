from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.functions import vectors as V
from lakelens.operators import chunking
from lakelens.operators.chunking import RecursiveChunker


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("v")).first()["v"]


def test_ch1_sanitize(spark):
    text = "Hi​ \x00there\r\n\r\n\r\n\r\n[INST] x <|im_start|>  "
    assert one(spark, T.sanitize(F.col("text")), text) == "Hi there\n\n&#91;INST&#93; x &lt;|im_start|&gt;"
    assert one(spark, T.sanitize(F.col("text")), "ﬁne") == "fine"
    assert one(spark, T.sanitize(F.col("text")), None) == ""


def test_tk1_bm25_tokens(spark):
    got = one(spark, T.bm25_tokens(F.col("text")), "Security flaw CVE-2024-1234 affects SKU-8921-X. Lodging is $250 in Tier-1. Naïve")
    assert {"cve-2024-1234", "sku-8921-x", "$250", "tier-1", "naïve"} <= set(got)


def test_tk4_numbers_and_tk2_tokens(spark):
    assert set(one(spark, T.grounding_numbers(F.col("text")), "pay $1,200 or 3.5")) == {"$1", "200", "3.5"}
    assert one(spark, T.grounding_tokens(F.col("text")), "Costs $250") == ["costs", "250"]


def test_tk6_stem(spark):
    got = one(spark, F.transform(F.split("text", " "), T.stem), "automation running policies boxes walked cats as")
    assert got == ["autom", "runn", "polic", "box", "walk", "cat", "as"]


def test_tk8_sentences():
    text = "The allowance is $50 per day [Source 1]. Receipts are required for dinner [Source 2]. See Dr. Smith at once."
    assert len(T.split_sentences(text)) == 3
    assert T.split_sentences("- First item is here.\n- Second item, e.g. this one, is here.\nno.") == ["First item is here.", "Second item, e.g. this one, is here."]
    assert T.split_sentences("founded in 2010. The next one") == ["founded in The next one"]
    assert T.split_sentences(None) == []


def test_tk9_tk10_citations(spark):
    assert one(spark, T.source_indices(F.col("text")), "a [Source 2, 1] b [Doc 3]") == [1, 2, 3]
    assert one(spark, T.source_indices(F.col("text")), "none") == []
    assert one(spark, T.strip_citations(F.col("text")), "A fact [Source 1] .  Next") == "A fact. Next"


def test_ch4_chunker_invariants():
    text = "\n\n".join(f"Section {i}. " + "word " * 20 for i in range(4))
    chunks = RecursiveChunker(120, 30).chunk(text)
    assert len(chunks) > 1 and [c[0] for c in chunks] == list(range(len(chunks)))
    assert all(text[a:b] == c for _, c, a, b in chunks)
    covered = {i for _, _, a, b in chunks for i in range(a, b)}
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_ch5_windows_are_as_long_as_they_can_be():
    """One separator: runs of pieces, each as long as fits, beginning with the most pieces before it that fit the overlap."""
    import random

    rng = random.Random(4)
    for _ in range(200):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 60))]
        size, overlap = rng.randint(13, 60), rng.randint(0, 12)
        chunks = [c.split(" ") for _, c, _, _ in RecursiveChunker(size, overlap, (" ", "")).chunk(" ".join(pieces))]
        long = lambda run: len(" ".join(run))
        at = kept = 0
        for n, run in enumerate(chunks):
            if n:
                before = chunks[n - 1]
                kept = next(k for k in range(len(before), -1, -1) if k == 0 or (before[-k:] == run[:k] and long(before[-k:]) <= overlap))
                assert kept == max((k for k in range(len(before) + 1) if long(before[len(before) - k :]) <= overlap), default=0)
                at -= kept
            assert run == pieces[at : at + len(run)]
            at += len(run)
            # a run after the first has one separator less of room, but takes the piece that did not fit before it
            assert (long(run) <= size or n and len(run) == kept + 1) and (at == len(pieces) or long(pieces[at - len(run) : at + 1]) + (n > 0) > size)
        assert at == len(pieces)


def test_ch6_offsets_are_those_of_the_text():
    text = "same words. same words. same words. " * 40
    chunks = RecursiveChunker(90, 20).chunk(text)
    assert all(text[a:b] == c for _, c, a, b in chunks) and [a for _, _, a, _ in chunks] == sorted({a for _, _, a, _ in chunks})


def test_ch7_pages_and_summary(spark):
    rows = spark.createDataFrame([(1, "a" * 60 + "\n\n" + "b" * 60, [(1, 60), (2, 122)])], "document_id long, content string, pages array<struct<page:int,end:int>>")
    got = chunking.chunk_documents(rows, 80, 10).orderBy("chunk_index").collect()
    assert (got[0]["page_number"], got[-1]["page_number"]) == (1, 2) and got[0]["chunk_id"] == "1:chunk_0" and len(got[0]["chunk_hash"]) == 64
    assert chunking.document_summary(rows, chunking.chunk_documents(rows, 80, 10)).first()["total_characters"] == 122


def test_ch3_dedup(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "document_id long, checksum string")
    got = {r["document_id"]: r["status"] for r in chunking.dedup_documents(rows).collect()}
    assert got == {1: "ingested", 2: "skipped_duplicate", 3: "ingested", 4: "ingested", 5: "skipped_duplicate"}
    assert chunking.distinct_documents(rows.unionByName(rows)).count() == 5


def test_rk1_hash_embedding(spark):
    import hashlib
    import math

    got = one(spark, V.hash_embedding(F.col("text"), 40), "hello")
    h = hashlib.sha256(b"hello").digest()
    raw = [((h[i % 32] ^ (i % 256)) / 127.5) - 1.0 for i in range(40)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert all(abs(a - b / norm) < 2e-6 for a, b in zip(got, raw))
