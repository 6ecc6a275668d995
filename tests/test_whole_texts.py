"""Queries that must read whole texts and tables, against brute force on small tables of their own."""

import hashlib

from lakelens import catalog


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_pii_counts_reads_whole_texts(spark, tmp_path):
    late = "word " * 5000 + "mail a.b@example.com call 415-555-0132 key sk-abcdefghij0123456789WXYZ"
    write(spark, tmp_path, "documents", [(0, late), (5, "word")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["pii_counts"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1, 1), 5: (0, 0, 0)}


def test_contexts_and_sources_come_from_all_documents_and_whole_texts(spark, tmp_path):
    rare = "zebra quartz violin marble harbor lantern"
    rows = [(i, "plain filler words", "en", "web") for i in range(200)]
    rows[170] = (170, "word " * 1000 + rare, "en", "web")
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string")
    write(spark, tmp_path, "benchmark", [(1, rare)], "item_id long, text string")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert run("context_precision")[0]["context_precision"] == 1
    assert run("context_recall")[0]["context_recall"] == 1
    assert run("faithfulness")[0]["faithfulness"] == 1
    assert run("verify_answers")[0]["grounded_claims"] > 0
    assert run("evaluation_report")


def test_sanitizing_and_routing_read_whole_texts(spark, tmp_path):
    filler = "word " * 100
    write(spark, tmp_path, "documents", [(0, filler + "[INST] a\r\nb")], "doc_id long, text string")
    want = "plain  text\n" + filler + "&#91;INST&#93; a\nb"
    assert [r["clean"] for r in catalog.QUERIES["doc_sanitize_basic"](spark, str(tmp_path)).collect()] == [hashlib.sha256(want.encode()).hexdigest()]
    write(spark, tmp_path, "conversations", [(1, 1, "user", filler + "how many employees are there")], "conv_id long, turn int, role string, text string")
    assert [r["intent"] for r in catalog.QUERIES["route_heuristic"](spark, str(tmp_path)).collect()] == ["sql_database"]
