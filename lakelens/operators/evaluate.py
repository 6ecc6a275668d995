"""Answer and retrieval metrics over sample tables (AG6-AG12, WN2). Samples: sample_id, query, answer, ground_truth, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.functions import vectors as V

THRESHOLDS = {"faithfulness": 0.80, "answer_relevance": 0.75, "context_precision": 0.70, "context_recall": 0.70}
CLAIM_OVERLAP, CONTEXT_OVERLAP = 0.40, 0.25


def share(words: Column, of: Column) -> Column:
    return F.size(F.array_intersect(words, of)) / F.nullif(F.size(words), F.lit(0))


def lexical_relevance(query: Column, answer: Column) -> Column:
    stems = lambda c: F.array_distinct(F.transform(T.eval_words(c), T.stem))
    q, a = stems(query), stems(answer)
    both = F.size(F.array_intersect(q, a))
    score = F.round(F.least(F.lit(1.0), 0.60 + 0.35 * both / F.nullif(F.size(q), F.lit(0))), 4)
    empty = (F.trim(query) == "") | (F.trim(answer) == "")
    return F.when(empty, F.lit(0.0)).when((F.size(q) == 0) | (F.size(a) == 0), F.lit(0.75)).when(both == 0, F.lit(0.20)).otherwise(score)


def embedding_relevance(query_vector: Column, answer_vector: Column) -> Column:
    return F.round(V.cosine(query_vector, answer_vector, low=0.0), 4)


def _sentence_share(samples: DataFrame, text: str, out: str, numbers: bool) -> DataFrame:
    """Share of a text's sentences whose words (and numbers) are in the joined contexts."""
    joined = F.array_join("contexts", " ")
    rows = samples.select("sample_id", F.explode(T.sentences(text)).alias("s"), T.eval_tokens(joined).alias("ct"), T.eval_numbers(joined).alias("cn"))
    words = T.eval_words(F.col("s"))
    covered = (F.size(words) == 0) | (share(words, F.col("ct")) >= CLAIM_OVERLAP)
    if numbers:
        covered = (F.size(words) == 0) | ((share(words, F.col("ct")) >= CLAIM_OVERLAP) & (F.size(F.array_except(T.eval_numbers(F.col("s")), F.col("cn"))) == 0))
    return rows.withColumn("ok", F.coalesce(covered, F.lit(False))).groupBy("sample_id").agg(F.round(F.avg(F.col("ok").cast("double")), 4).alias(out))


def faithfulness(samples: DataFrame) -> DataFrame:
    got = _sentence_share(samples, "answer", "share", True)
    free = (F.trim("answer") == "") | F.lower("answer").contains("insufficient information") | F.lower("answer").contains("not have enough information")
    score = F.when(free, F.lit(1.0)).when(F.size("contexts") <= 0, F.lit(0.0)).otherwise(F.coalesce("share", F.lit(1.0)))
    return samples.join(got, "sample_id", "left").select("sample_id", score.alias("faithfulness"))


def context_recall(samples: DataFrame) -> DataFrame:
    got = _sentence_share(samples, "ground_truth", "share", False)
    score = F.when(F.trim("ground_truth") == "", F.lit(1.0)).when(F.size("contexts") <= 0, F.lit(0.0)).otherwise(F.coalesce("share", F.lit(1.0)))
    return samples.join(got, "sample_id", "left").select("sample_id", score.alias("context_recall"))


def context_precision(samples: DataFrame) -> DataFrame:
    """Mean over relevant contexts of the precision at their position."""
    rows = samples.select("sample_id", T.eval_words(F.col("ground_truth")).alias("gt"), F.posexplode("contexts").alias("at", "c"))
    rows = rows.withColumn("rel", (F.coalesce(share(F.col("gt"), T.eval_tokens(F.col("c"))), F.lit(1.0)) >= CONTEXT_OVERLAP).cast("int"))
    running = F.sum("rel").over(Window.partitionBy("sample_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("p", F.when(F.col("rel") == 1, running / (F.col("at") + 1)))
    got = rows.groupBy("sample_id").agg(F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 4).alias("p"))
    none = (F.size("contexts") <= 0) | (F.trim("ground_truth") == "")
    score = F.when(none, F.lit(0.0)).when(F.size(T.eval_words(F.col("ground_truth"))) == 0, F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0.0)))
    return samples.join(got, "sample_id", "left").select("sample_id", score.alias("context_precision"))


def evaluate(samples: DataFrame) -> DataFrame:
    """The four metrics of every sample; answer defaults to the ground truth where null."""
    samples = samples.withColumn("answer", F.coalesce("answer", "ground_truth"))
    relevance = samples.select("sample_id", lexical_relevance(F.col("query"), F.col("answer")).alias("answer_relevance"))
    out = faithfulness(samples).join(relevance, "sample_id")
    return out.join(context_precision(samples), "sample_id").join(context_recall(samples), "sample_id")


def summarize(results: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(metric, mean, min, max, threshold, passed); an empty table gives zeros."""
    stacked = results.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in thresholds))).alias("x")).select("x.*")
    spark = results.sparkSession
    names = spark.createDataFrame([(m, float(t)) for m, t in thresholds.items()], "metric string, threshold double")
    sums = stacked.groupBy("metric").agg(*(F.round(f("value"), 4).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
    return names.join(sums, "metric", "left").fillna(0.0, ["mean", "min", "max"]).withColumn("passed", (F.col("mean") >= F.col("threshold")) & (F.col("mean") > 0))
