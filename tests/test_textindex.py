"""The stored inverted index against search over the same chunks."""

import random

import pytest
from pyspark.sql import functions as F

from lakelens.functions import latin
from lakelens.operators import retrieve, textindex
from lakelens.queries import texts
from tests.conftest import TINY


def rows(found):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in found.collect())


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return spark.createDataFrame([*data, (n, ""), (n + 1, None), (n + 2, data[0][1]), (n + 3, data[0][1])], "chunk_id long, content string")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w9"), (2, "w3 w3 w1"), (3, "nowhere"), (4, "w40 w2 w77 w5"), (5, "")], "query_id long, query string")


@pytest.mark.parametrize("k,block", [(1, 4), (5, 8), (50, 16), (10, 128)])
def test_same_rows_as_a_search_without_an_index(spark, tmp_path, k, block):
    index = textindex.TextIndex(spark, f"{tmp_path}/i", block)
    index.add(corpus(spark))
    assert rows(index.search(asked(spark), k)) == rows(retrieve.bm25_search(asked(spark), corpus(spark), k))


def test_add_delete_replace_and_merge_equal_a_fresh_index(spark, tmp_path, monkeypatch):
    docs, index = corpus(spark), textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    index.add(docs.filter("chunk_id < 200"))
    index.add(docs.filter("chunk_id >= 200"))
    index.delete(docs.filter("chunk_id % 7 = 0").select("chunk_id"))
    changed = docs.filter("chunk_id % 11 = 0").select("chunk_id", F.concat(F.lit("w1 w2 "), F.coalesce("content", F.lit(""))).alias("content"))
    index.add(changed)
    now = docs.filter("chunk_id % 7 <> 0 AND chunk_id % 11 <> 0").unionByName(changed)
    want = rows(retrieve.bm25_search(asked(spark), now, 10))
    assert index.statistics() == (now.count(), retrieve.corpus_stats(now.fillna("")).first()["avgdl"]) and rows(index.search(asked(spark), 10)) == want
    monkeypatch.setattr(textindex.T, "bm25_tokens", None)  # nothing is tokenized again
    index.delete(spark.createDataFrame([(99_999,)], "chunk_id long"))
    index.merge()
    assert len(index.log.all()) == 1
    monkeypatch.undo()
    assert rows(index.search(asked(spark), 10)) == want


def test_a_lost_write_is_not_there(spark, tmp_path, monkeypatch):
    index = textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    with pytest.raises(ValueError, match="empty"):
        index.search(asked(spark))
    index.add(corpus(spark, 50))
    want = rows(index.search(asked(spark), 5))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(textindex.TextIndex, "_blocks", lost)
    with pytest.raises(RuntimeError):
        index.add(corpus(spark, 60, 2))
    monkeypatch.undo()
    assert rows(index.search(asked(spark), 5)) == want
    index.add(corpus(spark, 60, 2))
    assert rows(index.search(asked(spark), 5)) == rows(retrieve.bm25_search(asked(spark), corpus(spark, 60, 2), 5))


def test_scored_postings_fall_with_k(spark, tmp_path):
    index = textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    index.add(texts.as_chunks(spark, TINY).select("chunk_id", "content"))
    queries = texts.benchmark_queries(spark, TINY).limit(20)
    found = [index.report(queries, k).agg(F.sum("postings"), F.sum("scored")).first() for k in (1, 10, 100)]
    assert len({f[0] for f in found}) == 1 and found[0][1] < found[1][1] < found[2][1] <= found[2][0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_writes_and_searches_move_no_entries_between_tasks(spark, tmp_path):
    index = textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    index.add(corpus(spark))
    assert "Exchange" not in plan(index._blocks(index.log.read("chunks", index.log.all())))
    assert "Join" not in plan(index.search(asked(spark), 5))


@pytest.mark.parametrize("segment,block,k", [(1, 2, 3), (50, 4, 1), (2000, 8, 10)])
def test_segments_of_any_size_give_the_same_rows(spark, tmp_path, segment, block, k):
    docs, index = corpus(spark, 200).coalesce(2), textindex.TextIndex(spark, f"{tmp_path}/i", block, segment)
    index.add(docs)
    index.delete(docs.filter("chunk_id % 3 = 0").select("chunk_id"))
    index.add(docs.filter("chunk_id % 6 = 0"))
    assert rows(index.search(asked(spark), k)) == rows(retrieve.bm25_search(asked(spark), docs.filter("chunk_id % 3 <> 0 OR chunk_id % 6 = 0"), k))


def test_text_ids_and_no_id_die_like_others(spark, tmp_path):
    index = textindex.TextIndex(spark, f"{tmp_path}/i", 4)
    ids = F.when(F.col("chunk_id") % 50 > 0, F.concat(F.lit("id"), "chunk_id"))
    docs = corpus(spark, 120).select(ids.alias("chunk_id"), "content")
    index.add(docs)
    index.delete(docs.filter("chunk_id IS NULL OR chunk_id LIKE '%7'").select("chunk_id"))
    assert rows(index.search(asked(spark), 5)) == rows(retrieve.bm25_search(asked(spark), docs.filter("NOT (chunk_id IS NULL OR chunk_id LIKE '%7')"), 5))


@pytest.mark.parametrize("many", ["terms", "dead ids"])
def test_what_is_too_much_for_the_workers_is_joined(spark, tmp_path, monkeypatch, many):
    docs, index = corpus(spark, 200), textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    index.add(docs)
    index.delete(docs.filter("chunk_id % 5 = 0").select("chunk_id"))
    want = rows(index.search(asked(spark), 7))
    monkeypatch.setattr(*((retrieve, "WEIGHT_ROWS", 1) if many == "terms" else (textindex, "GONE", 1)))
    assert index._asks(asked(spark)) is None and rows(index.search(asked(spark), 7)) == want


def test_words_are_those_of_the_tokenizer(spark, tmp_path):
    texts_ = ["ΟΔΟΣ ΑΣ.Β ΑΣ-Β Σ ΣΑΣ_Σ", "İstanbul I ǅ É-É ﬁN $Ab-c--D x-", "", None, "...", "A\u200db ÀÉ ẞ\u0345Σ' Σ\u00ad Β", "Aa aA AA\nß SS"]
    data = spark.createDataFrame(list(enumerate(texts_)), "chunk_id long, content string")
    index = textindex.TextIndex(spark, f"{tmp_path}/i")
    index.add(data)
    found = {r["chunk_id"]: (r["dl"], dict(zip(r["words"].split(" "), r["tfs"], strict=True)) if r["words"] else {}) for r in index.log.read("chunks", index.log.all()).collect()}
    tokens = {r["chunk_id"]: r["t"] or [] for r in data.select("chunk_id", textindex.T.bm25_tokens(F.col("content")).alias("t")).collect()}
    assert found == {i: (len(t), {w: t.count(w) for w in t}) for i, t in tokens.items()}


def test_changes_shuffle_only_repeated_texts_and_a_search_after_them_joins_nothing(spark, tmp_path):
    docs, index = corpus(spark, 100), textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    assert "Exchange" not in plan(index._last(docs))
    index.add(docs)
    index.delete(docs.filter("chunk_id % 7 = 0").select("chunk_id"))
    again = [(1, "w1 w2"), (1, "w9 w9"), (1, None), (None, "w3"), (None, "w1 w3"), (2, "w2 w5")]
    index.add(spark.createDataFrame(again, "chunk_id long, content string"))
    last = spark.createDataFrame([(1, "w9 w9"), (None, "w3"), (2, "w2 w5")], "chunk_id long, content string")
    found = index.search(asked(spark), 10)
    assert "Join" not in plan(found)
    got, want = (sorted(map(str, df.collect())) for df in (found.select("query_id", "chunk_id", "score", "rank"), retrieve.bm25_search(asked(spark), docs.filter("chunk_id % 7 <> 0 AND chunk_id > 2").unionByName(last), 10).select("query_id", "chunk_id", "score", "rank")))
    assert got == want


def test_latin_texts_are_cut_as_by_the_regular_expression(spark):
    rng = random.Random(2)
    known = [chr(i) for i in [*range(0x250), *range(0x2010, 0x203F), 0x20AC]]
    texts_ = [t for c in known for t in (c, f"a{c}B", f"A-{c}-b {c}{c}", f"${c}-x${c}")]
    texts_ += ["".join(rng.choice(known + list("aB9_$--  ΣĀ😀")) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts_ += ["".join(rng.choice("aB9_$-- é\nß²") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", None, "a-", "$", "-b", "ab"]
    data = spark.createDataFrame(list(enumerate(texts_)), "chunk_id long, content string")
    others = {r[0] for r in data.filter(latin.is_other(F.col("content"))).select("chunk_id").collect()}
    assert 0 < len(others) < len(texts_) / 2 and all(texts_[i].isascii() is False for i in others)
    found = {r["chunk_id"]: (r["dl"], dict(zip(r["words"].split(" "), r["tfs"], strict=True)) if r["words"] else {}) for r in textindex._counted(data).collect()}
    tokens = {r["chunk_id"]: r["t"] or [] for r in data.select("chunk_id", textindex.T.bm25_tokens(F.col("content")).alias("t")).collect()}
    assert found == {i: (len(t), {w: t.count(w) for w in t}) for i, t in tokens.items()}


def test_no_write_shuffles_terms_for_their_frequencies(spark, tmp_path):
    docs, index = corpus(spark, 60), textindex.TextIndex(spark, f"{tmp_path}/i", 8)
    index.add(docs)
    assert not (tmp_path / "i" / "frequencies").exists()
    chunks = index.log.read("chunks", index.log.all())
    assert "Exchange" not in plan(index._fewer(chunks))
    index.delete(docs.filter("chunk_id % 2 = 0").select("chunk_id"))
    frequencies = lambda df: {r["term"]: r["df"] for r in df.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").collect()}
    assert frequencies(index._frequencies(index.log.all())) == frequencies(retrieve.term_frequencies(retrieve.build_postings(docs.filter("chunk_id % 2 = 1"))))
