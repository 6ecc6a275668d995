"""The stored vector index against exact search over the same vectors."""

import numpy as np
from pyspark.sql import functions as F

from lakelens.operators import retrieve, vectorindex
from lakelens.queries import texts
from tests.conftest import SMALL


def rows(found):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in found.collect())


def clustered(spark, n=1200, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dims))
    data = [(i, (centres[i % 15] + 0.3 * rng.normal(size=dims)).tolist(), i % 4) for i in range(n)]
    data += [(n + i, data[7][1], 1) for i in range(30)]  # copies
    data += [(n + 40, [0.0] * dims, 1), (n + 41, [1.0, 2.0], 1), (n + 42, None, 1), (n + 43, [], 0)]
    return spark.createDataFrame(data, "chunk_id long, embedding array<double>, label int")


def test_exact_rows_and_recall(spark, tmp_path):
    vectors = texts.vector_table(spark, SMALL)
    queries = texts.vector_queries(spark, SMALL)
    index = vectorindex.VectorIndex(spark, f"{tmp_path}/i")
    index.build(vectors)
    want = rows(retrieve.dense_search(queries, vectors, 10))
    assert index.count() == vectors.count() and rows(index.search(queries, 10, exact=True)) == want
    near = {(q, c) for q, _, c, _ in rows(index.search(queries, 10, probes=14))}
    assert len(near & {(q, c) for q, _, c, _ in want}) >= 0.9 * len(want)


def test_filters_odd_vectors_deletes_and_replacements(spark, tmp_path):
    vectors = clustered(spark)
    queries = vectors.filter("chunk_id % 97 = 0 OR chunk_id = 1241").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vectorindex.VectorIndex(spark, f"{tmp_path}/i")
    index.build(vectors.filter("chunk_id % 3 <> 0"), lists=20)
    index.add(vectors.filter("chunk_id % 3 = 0"))
    assert rows(index.search(queries, 7, exact=True)) == rows(retrieve.dense_search(queries, vectors, 7))
    some = F.col("label") == 1
    assert rows(index.search(queries, 7, exact=True, where=some, min_score=0.2)) == rows(retrieve.dense_search(queries, vectors, 7, some, 0.2))
    index.delete(vectors.filter("chunk_id % 5 = 0"))
    changed = vectors.filter("chunk_id % 7 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.add(changed)
    index.delete(spark.createDataFrame([(10**9,)], "chunk_id long"))
    now = vectors.filter("chunk_id % 5 <> 0 AND chunk_id % 7 <> 1").unionByName(changed)
    assert index.count() == now.count() and rows(index.search(queries, 7, exact=True)) == rows(retrieve.dense_search(queries, now, 7))
    near = {(q, c) for q, _, c, _ in rows(index.search(queries, 7, probes=4))}
    assert len(near & {(q, c) for q, _, c, _ in rows(retrieve.dense_search(queries, now, 7))}) >= 0.9 * len(near)


def test_many_blocks_of_queries_and_empty_indexes(spark, tmp_path, monkeypatch):
    vectors = clustered(spark, 200)
    queries = vectors.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vectorindex.VectorIndex(spark, f"{tmp_path}/i")
    index.build(vectors, lists=6)
    want = rows(retrieve.dense_search(queries, vectors, 3))
    monkeypatch.setattr(vectorindex.R, "MATRIX_VALUES", 48)
    assert rows(index.search(queries, 3, exact=True)) == want
    empty = vectorindex.VectorIndex(spark, f"{tmp_path}/e")
    empty.build(vectors.filter("false"))
    assert empty.count() == 0 and empty.search(queries, 3, exact=True).isEmpty()
