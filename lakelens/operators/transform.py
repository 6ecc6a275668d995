"""Query transformations through a model: hypothetical answers, variations, step-back questions (RG8, RK20-RK23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.functions import models
from lakelens.functions import vectors as V
from lakelens.operators import retrieve

PROMPTS = {
    "hyde": "Write a short passage that answers the question as a handbook would.\nQuestion: {query}",
    "multi_query": "Rewrite the question in {n} different ways, one on each line.\nQuestion: {query}",
    "step_back": "Ask the more general question behind this one.\nAnswer as:\nStep-Back Question: ...\nRationale: ...\nQuestion: {query}",
}


def strip(text: Column, marks: str = "") -> Column:
    """Without white space, and then without ``marks``, at both ends."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    for mark in marks:
        bare = F.btrim(bare, F.lit(mark))
    return bare


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R"), lambda line: strip(line)), lambda line: line != "")


def variations(query: Column, answer: Column, n: int = 3) -> Column:
    """The query and the first ``n`` lines of an answer that are new, whatever their case; list marks and quotes go."""
    bare = F.transform(lines(answer), lambda line: strip(strip(F.regexp_replace(line, r"^(?:\d+[.)]|[-*])\s*", ""), "\"'")))
    new = F.filter(bare, lambda line: (line != "") & (F.lower(line) != F.lower(strip(query))))

    def firsts(found: Column) -> Column:
        return V.let(F.transform(found, F.lower), lambda low: F.filter(found, lambda line, i: F.array_position(low, F.lower(line)) == i + 1))

    return F.concat(F.array(query), F.slice(V.let(new, firsts), 1, n))


def step_back(query: Column, answer: Column) -> Column:
    """(question, rationale): the labelled ones, else the answer's first line, else the query."""
    labelled = lambda label: F.nullif(strip(F.regexp_extract(answer, rf"(?i){label}:\s*(.+)", 1)), F.lit(""))
    question = labelled("Step-Back Question")
    return F.struct(F.coalesce(question, F.get(lines(answer), 0), query).alias("question"), F.when(question.isNotNull(), labelled("Rationale")).alias("rationale"))


def hypothesis(query: Column, answer: Column) -> Column:
    """The answer as a text to search with, without quotes around it; the query if it is empty."""
    return F.coalesce(F.nullif(strip(answer, "\"'"), F.lit("")), query)


def texts_of(query: Column, answer: Column, mode: str, n: int = 3) -> Column:
    """The texts to search with instead of, or besides, a query."""
    if mode == "multi_query":
        return variations(query, answer, n)
    return F.array(query, step_back(query, answer)["question"]) if mode == "step_back" else F.array(hypothesis(query, answer))


def transform(queries: DataFrame, mode: str, model: models.BatchModel, n: int = 3) -> DataFrame:
    """(query_id, variant, query) from (query_id, query)."""
    if mode not in PROMPTS:
        raise ValueError(f"unknown transformation {mode}")
    before, after = PROMPTS[mode].format(query="\0", n=n).split("\0")
    answer = models.answers(model, F.concat(F.lit(before), "query", F.lit(after)))
    asked = queries.select("query_id", "query", answer.alias("answer"))
    return asked.select("query_id", F.posexplode(texts_of(F.col("query"), F.col("answer"), mode, n)).alias("variant", "query"))


def transformed_search(queries: DataFrame, vectors: DataFrame, mode: str, model: models.BatchModel, embed, k: int = 5, rerank: bool = True) -> DataFrame:
    """Dense search with all variants in one job, the best score of each chunk, then rerank by the original query or sort."""
    variants = transform(queries, mode, model).withColumn("embedding", embed(F.col("query")))
    tagged = variants.select(F.struct("query_id", "variant").alias("query_id"), "embedding")
    found = retrieve.dense_search(tagged, vectors, max(2 * k, 20))
    best = found.groupBy(F.col("query_id.query_id").alias("query_id"), "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("query_id.variant", "rank")).alias("seen"))
    merged = retrieve.top_k(best, max(2 * k, 20), F.desc("score"), F.asc("seen")).drop("seen")
    if not rerank:
        return merged.filter(F.col("rank") <= k)
    return retrieve.rerank_lexical(queries, retrieve.with_content(merged, vectors, retrieve.fits(queries, max(2 * k, 20))), k)
