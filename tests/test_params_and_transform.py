import pytest
from pyspark.sql import functions as F

from lakelens.functions import models
from lakelens.functions import vectors as V
from lakelens.operators import params, transform
from lakelens.plans import sqlguard
from lakelens.sources import relational


def test_fl12_bounds():
    assert params.Search("q").rrf_k == 60
    for bad in ({"top_k": 0}, {"top_k": 101}, {"rrf_k": 501}, {"dense_weight": 1.5}, {"fusion": "x"}):
        with pytest.raises(ValueError):
            params.Search("q", **bad)
    with pytest.raises(ValueError):
        params.Search(" ")
    with pytest.raises(ValueError):
        params.Agent("q", max_iterations=99)


def test_rg8_transformations(spark):
    model = models.each(lambda prompt: "1. alpha\n2. beta" if "different ways" in prompt else "Step-Back Question: alpha\nRationale: r")
    texts = lambda mode: [r["query"] for r in transform.transform(spark.createDataFrame([(0, "q")], "query_id long, query string"), mode, model).orderBy("variant").collect()]
    assert texts("multi_query") == ["q", "alpha", "beta"] and texts("step_back") == ["q", "alpha"]
    embed = lambda text: V.hash_embedding(text, 16)
    chunks = spark.createDataFrame([("a", "alpha"), ("b", "beta"), ("c", "gamma")], "chunk_id string, content string")
    vectors = chunks.withColumn("embedding", embed(chunks["content"]))
    queries = spark.createDataFrame([(0, "gamma question")], "query_id long, query string")
    got = transform.transformed_search(queries, vectors, "multi_query", model, embed, 2, rerank=False).collect()
    assert {r["chunk_id"] for r in got} == {"a", "b"} and all(r["score"] > 0.999 for r in got)
    best = transform.transformed_search(queries, vectors, "multi_query", model, embed, 1).first()
    assert best["chunk_id"] == "c"
    with pytest.raises(ValueError):
        transform.transform(queries, "other", model)


def test_ap2_ap3_parsing_of_answers(spark):
    cases = [("q", '1. "First"\n- second\nq\n3) third\nfourth'), ("q", ""), ("Kafka lag", "1. Causes\n2) Latency\n- Timeout\n1. causes\n"), ("q", "Step-Back Question: why?\nRationale: because"), ("q", "\n  plain line \nmore"), ("q", "'Quoted answer.'\n")]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c struct<q:string,a:string>").select("i", "c.*")
    q, a = F.col("q"), F.col("a")
    got = rows.select("i", transform.variations(q, a).alias("v"), transform.step_back(q, a).alias("s"), transform.hypothesis(q, a).alias("h")).orderBy("i").collect()
    assert [r["v"] for r in got[:3]] == [["q", "First", "second", "third"], ["q"], ["Kafka lag", "Causes", "Latency", "Timeout"]]
    assert [tuple(r["s"]) for r in got[3:5]] == [("why?", "because"), ("plain line", None)] and tuple(got[1]["s"]) == ("q", None)
    assert [r["h"] for r in (got[1], got[5])] == ["q", "Quoted answer."]


def test_src9_seed(spark):
    relational.register(spark)
    got = sqlguard.execute(spark, "SELECT d.name, count(*) AS n, avg(salary) AS pay FROM employees e JOIN departments d ON d.id = e.department_id GROUP BY d.name HAVING count(*) > 3 ORDER BY pay DESC")
    assert got.row_count == 5 and not got.is_truncated
    assert {n: d.count() for n, d in relational.tables(spark).items()} == {"departments": 5, "employees": 20, "products": 10, "sales_orders": 25}
