from pyspark.sql import functions as F

from lakelens.operators import rag, retrieve, router


def chunks(spark):
    rows = [("c1", "Protocol CVE-2024-9988 mitigates remote execution in the gateway", "Security"), ("c2", "General software patch notes and release schedule", "Engineering")]
    return spark.createDataFrame(rows, "chunk_id string, content string, department string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def test_rk10_bm25_exact_code_and_filter(spark):
    got = retrieve.bm25_search(ask(spark, "CVE-2024-9988"), chunks(spark), 5).collect()
    assert got[0]["chunk_id"] == "c1" and got[0]["score"] > 0.5
    none = retrieve.bm25_search(ask(spark, "CVE-2024-9988"), chunks(spark), 5, F.col("department") == "Engineering")
    assert none.isEmpty()
    assert retrieve.bm25_search(ask(spark, "zzz"), chunks(spark), 5).isEmpty()


def test_rk10_normalised_before_filter(spark):
    rows = spark.createDataFrame([("a", "alpha alpha alpha", 1), ("b", "alpha beta gamma delta", 2)], "chunk_id string, content string, k int")
    got = retrieve.bm25_search(ask(spark, "alpha"), rows, 5, F.col("k") == 2).collect()
    assert len(got) == 1 and got[0]["score"] < 1.0


def test_rk5_dense_keeps_negative_scores(spark):
    v = spark.createDataFrame([("p", [1.0, 0.0, 0.0]), ("n", [-1.0, 0.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["score"] for r in retrieve.dense_search(q, v, 5).orderBy("rank").collect()] == [1.0, -1.0]
    assert retrieve.dense_search(q, v, 5, min_score=0.5).count() == 1


def lists(spark, d, s):
    schema = "query_id long, chunk_id string, score double, rank int"
    return spark.createDataFrame(d, schema), spark.createDataFrame(s, schema)


def test_rk12_rrf(spark):
    got = retrieve.fuse_rrf(*lists(spark, [(0, "both", 0.95, 1), (0, "d", 0.85, 2)], [(0, "both", 0.9, 1), (0, "s", 0.75, 2)])).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["both", "d", "s"] and abs(got[0]["combined_score"] - 1 / 61) < 1e-4


def test_rk13_linear(spark):
    got = retrieve.fuse_linear(*lists(spark, [(0, "c1", 0.8, 1)], [(0, "c1", 10.0, 1)])).first()
    assert got["combined_score"] == 1.0


def test_rk16_rerank_and_forced(spark):
    c = spark.createDataFrame([(0, "c1", "apples and pears", 0.8, 1), (0, "c2", "travel policy and receipts", 0.4, 2)], "query_id long, chunk_id string, content string, score double, rank int")
    got = retrieve.rerank_lexical(ask(spark, "travel policy receipts"), c).orderBy("final_rank").collect()
    assert got[0]["chunk_id"] == "c2" and got[0]["initial_rank"] == 2
    forced = retrieve.rerank_lexical(ask(spark, "x"), c, 1, {"c1": 0.99, "c2": 0.12}).collect()
    assert [r["chunk_id"] for r in forced] == ["c1"]


def test_rk5_blocks_of_queries_equal_one_matrix(spark, monkeypatch):
    import random

    rng = random.Random(5)
    vector = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(f"c{i}", vector(6)) for i in range(70)] + [("other", vector(3)), ("none", None), ("zero", [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, vector(6)) for i in range(30)] + [(99, vector(3)), (98, [])], "query_id long, embedding array<double>").repartition(3)
    search = lambda: sorted(map(tuple, retrieve.dense_search(queries, vectors, 5).select("query_id", "rank", "chunk_id", "score").collect()))
    want = search()
    monkeypatch.setattr(retrieve, "MATRIX_VALUES", 64)
    assert search() == want and len(want) == 32 * 5


def test_ag1_counts_inside_rows(spark):
    from collections import Counter

    texts = ["b a b c b", "", "one", "x " * 500 + "y", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    got = retrieve.build_postings(rows).collect()
    want = {(i, w, n, len(t.split())) for i, t in enumerate(texts) if t for w, n in Counter(t.split()).items()}
    assert {(r["chunk_id"], r["term"], r["tf"], r["dl"]) for r in got} == want
    plan = retrieve.build_postings(rows)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_rk9_joined_terms_equal_literal_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 13}" for k in range(20 + i))) for i in range(40)] + [(99, None), (98, "")], "chunk_id int, content string")
    queries = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w5 none"), (2, ""), (3, None)], "query_id int, query string")
    scores = lambda: sorted((r["query_id"], r["chunk_id"], round(r["raw"], 9)) for r in retrieve.bm25_scores(queries, rows).collect())
    want = scores()
    monkeypatch.setattr(retrieve, "LITERAL_TERMS", 2)
    assert scores() == want and len(want) > 40
    assert retrieve.bm25_scores(queries.filter("query_id > 1"), rows).isEmpty()


def test_small_sides_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, "t" * 1000, [1.0, 2.0]) for i in range(50)], "id int, t string, v array<double>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(retrieve.small(rows)) and not hinted(retrieve.small(rows, size=40_000)) and not hinted(retrieve.small(rows, rows=49))


def test_rk20_merge_keeps_best(spark):
    a, b = lists(spark, [(0, "x", 0.5, 1), (0, "y", 0.4, 2)], [(0, "y", 0.9, 1)])
    got = retrieve.merge_by_max([a, b]).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("y", 0.9), ("x", 0.5)]


def test_rt1_heuristics(spark):
    cases = {
        "Hello there!": "direct_chat",
        "How many employees do we have?": "sql_database",
        "What is the travel policy?": "rag_search",
        "Find the per diem and then calculate the total": "autonomous_agent",
        "something else": None,
    }
    rows = ask(spark, *cases).select("query", router.heuristic_intent(F.col("query"))["intent"].alias("i")).collect()
    assert {r["query"]: r["i"] for r in rows} == cases
    cases = {
        '```json\n{"intent": "rag_search", "confidence": 2}\n```': ("rag_search", 1.0),
        '{"intent": " SQL_Database "}': ("sql_database", 0.85),
        '{"intent": "rag_search", "confidence": "high"}': ("rag_search", 0.75),
        '{"intent": "none", "confidence": 1}': ("direct_chat", 0.5),
        "maybe sql_database": ("sql_database", 0.75),
        "?": ("direct_chat", 0.5),
    }
    got = spark.createDataFrame([(c,) for c in cases], "a string").select("a", router.model_intent(F.col("a")).alias("m")).collect()
    assert {r["a"]: tuple(r["m"]) for r in got} == cases
    targets = spark.createDataFrame([("sql_database", "select 1"), ("sql_database", "how many"), ("rag_search", "x")], "i string, q string")
    assert [r["t"] for r in targets.select(router.dispatch_target(F.col("i"), F.col("q")).alias("t")).collect()] == ["sql", "agent", "rag"]


def found(spark, *contents):
    rows = [(0, i, f"d{i}", f"f{i}", c) for i, c in enumerate(contents, 1)]
    return spark.createDataFrame(rows, "query_id long, rank int, document_id string, source string, content string")


def test_wn3_budget_stops_at_first_overflow(spark):
    assert rag.context_blocks(found(spark, "a" * 135, "b" * 135, "c"), 60).count() == 1
    assert [r["rank"] for r in rag.context_blocks(found(spark, "a" * 40, "b" * 900, "c"), 60).orderBy("rank").collect()] == [1]


def test_wn3_truncates_a_first_block(spark):
    got = rag.context_blocks(found(spark, "word " * 200, "x"), 20).collect()
    assert len(got) == 1 and "[Truncated to fit context window]" in got[0]["block"] and len(got[0]["content"]) <= 80


def test_ag4_grounding(spark):
    chunk = "The daily meal allowance is $75 per day for domestic travel."
    rows = spark.createDataFrame([("The daily meal allowance is $75 per day", chunk), ("Bananas orbit distant galaxies", chunk), ("The daily meal allowance is $99 per day", chunk)], "claim string, content string")
    a, b, c = (r["grounding_score"] for r in rag.with_grounding(rows).collect())
    assert a >= 0.65 and b < 0.25 and c < a


def test_ag5_verify(spark):
    src = spark.createDataFrame([(1, 1, "The meal allowance is $75 per day."), (1, 2, "Receipts are required above $25.")], "query_id long, source_index int, content string")
    rows = [(1, 1, "The meal allowance is $75 per day [Source 1]. Receipts are required above $25 [Source 2]."), (2, 1, "The moon is cheese [Source 9]."), (3, 1, "I do not have enough information to answer."), (4, 1, "Nothing is cited here at all.")]
    got = {r["answer_id"]: r for r in rag.verify_answers(spark.createDataFrame(rows, "answer_id long, query_id long, answer string"), src).collect()}
    assert (got[1]["faithfulness_score"], got[1]["grounding_status"]) == (1.0, "verified")
    assert got[2]["grounding_status"] == "unverified" and got[2]["unattributed_claims"] == 1
    assert got[3]["grounding_status"] == "insufficient_context" and got[4]["grounding_status"] == "unverified"


def test_rg2_empty_short_circuit(spark):
    empty = found(spark, "x").filter("false")
    assert rag.rag_query(ask(spark, "q"), empty).first()["answer"] == rag.INSUFFICIENT
    got = rag.rag_query(ask(spark, "q"), found(spark, "body")).first()
    assert "[Source 1 | Document: d1 | File: f1]" in got["context"] and got["answer"].startswith("[MOCK RESPONSE]")


def test_rk10_best_of_tasks_are_the_best_of_all(spark, monkeypatch):
    """Blocks of few chunks, rows dropped early, many equal scores: the rows of the joined form, and few of them shuffled."""
    monkeypatch.setattr(retrieve, "BLOCK_CHUNKS", 7)
    monkeypatch.setattr("lakelens.operators.best.HELD", 5)
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 5)) if i % 3 else "w1 same text w2", i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "chunk_id long, content string, k int").repartition(6)
    queries = spark.createDataFrame([(q, f"w{q} w{q + 1} w1 same") for q in range(9)] + [(9, "none"), (10, ""), (11, None)], "query_id long, query string")
    for options in ({}, {"where": F.col("k") == 1}, {"where": F.col("k") == 1, "over": "found", "min_score": 0.3}):
        found = lambda: sorted(map(tuple, retrieve.bm25_search(queries, docs, 4, **options).select("query_id", "rank", "chunk_id", "score").collect()))  # noqa: B023, E731
        got = found()
        with monkeypatch.context() as patch:
            patch.setattr(retrieve, "WEIGHT_ROWS", 0)
            assert got == found() and len(got) == 36
    given = retrieve.asked(queries)
    assert retrieve._weighed_scores(given, docs, 4, None, "all").count() < 0.5 * retrieve.bm25_scores(queries, docs).count()


def test_rk12_dense_tasks_hand_on_k_rows_for_each_query(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(400)], "chunk_id long, embedding array<double>").repartition(1)
    given = vectors.filter("chunk_id < 5").selectExpr("chunk_id AS query_id", "embedding").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    count = retrieve._matrix_scores(given, vectors.schema["chunk_id"].dataType, vectors, 3, 0.0).count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert count == 15
