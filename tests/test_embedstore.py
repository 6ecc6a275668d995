"""The content-addressed embedding store: how often a model is asked, and for what."""

from pyspark.sql import functions as F

from lakelens.operators import embedstore


def counting(folder):
    """A model that leaves a file for each call, with the texts that it was asked for."""

    def model(texts):
        import json
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as file:
            json.dump(texts, file)
        return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

    def calls():
        import json
        import os

        return [json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)]

    return model, calls


def test_asks_once_for_each_new_text(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    model, calls = counting(str(tmp_path / "calls"))
    store = embedstore.EmbeddingStore(spark, f"{tmp_path}/store", model, batch=16)
    rows = spark.range(300).select("id", F.concat(F.lit("text "), (F.col("id") % 90).cast("string")).alias("content"))
    rows = rows.unionByName(spark.createDataFrame([(900, None), (901, "")], "id long, content string"))
    first = {r["id"]: r["embedding"] for r in store.embed(rows).collect()}
    asked = [t for c in calls() for t in c]
    assert len(first) == 302 and len(asked) == len(set(asked)) == 91 and max(map(len, calls())) <= 16
    assert first[5] == first[95] == [6.0, float(sum(map(ord, "text 5")) % 97)] and first[900] == first[901]
    more = rows.unionByName(spark.createDataFrame([(1000, "text 3"), (1001, "new one")], "id long, content string"))
    again = {r["id"]: r["embedding"] for r in store.embed(more).collect()}
    assert [t for c in calls() for t in c if t not in asked] == ["new one"] and sum(map(len, calls())) == 92
    assert {k: again[k] for k in first} == first and again[1000] == first[3]
    assert store.embed(rows.filter("false")).isEmpty() and store.learn(rows.filter("false").select(F.lit("").alias("content_hash"), "content")) == 0
