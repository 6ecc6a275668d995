"""Experiment runs: versions, comparison with a baseline, leaders and sweeps (AG13-AG15, FL10, SNK6, GL5).

Runs: run_id, experiment_name, run_name, parameters map, metrics map<string,double>, tags, status, total_latency_ms, created_at, ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATENCY = "total_latency_ms"
SWEEP_WEIGHTS = {"faithfulness": 0.40, "answer_relevance": 0.30, "context_precision": 0.15, "context_recall": 0.15}


def latest(versions: DataFrame, key: str = "run_id", version: str = "version") -> DataFrame:
    """The newest version of each row of an append-only table."""
    newest = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def list_runs(runs: DataFrame, experiment: str | None = None, limit: int = 50) -> DataFrame:
    runs = runs if experiment is None else runs.filter(F.col("experiment_name") == experiment)
    return runs.orderBy(F.desc("created_at")).limit(limit)


def run_values(runs: DataFrame) -> DataFrame:
    """(run_id, ordinal, metric, value) for every metric that any run has; a missing one is 0."""
    own = runs.select("run_id", "ordinal", F.explode(F.map_concat("metrics", F.create_map(F.lit(LATENCY), F.col(LATENCY)))).alias("metric", "value"))
    metrics = own.select("metric").distinct()
    grid = runs.select("run_id", "ordinal").join(F.broadcast(metrics))  # metric names: a handful
    return grid.join(own, ["run_id", "ordinal", "metric"], "left").fillna(0.0, ["value"])


def compare_runs(runs: DataFrame, baseline: str) -> DataFrame:
    values = run_values(runs)
    base = values.filter(F.col("run_id") == baseline).select("metric", F.col("value").alias("b"))
    rows = values.filter(F.col("run_id") != baseline).join(F.broadcast(base), "metric")
    delta = F.round(F.col("value") - F.col("b"), 4)
    better = F.when(F.col("metric") == LATENCY, F.col("value") < F.col("b")).otherwise(F.col("value") > F.col("b"))
    pct = F.when(F.col("b") != 0, F.round(delta / F.nullif("b", F.lit(0.0)) * 100, 2)).otherwise(F.lit(0.0))
    return rows.select("run_id", "metric", F.round("b", 4).alias("baseline_val"), F.round("value", 4).alias("candidate_val"), delta.alias("absolute_delta"), pct.alias("percentage_delta"), better.alias("improved"))


def leaders(runs: DataFrame) -> DataFrame:
    """The best run of each metric (least latency, else greatest value); the first wins ties."""
    value = F.when(F.col("metric") == LATENCY, -F.col("value")).otherwise(F.col("value"))
    best = run_values(runs).groupBy("metric").agg(F.max(F.struct(value.alias("v"), (-F.col("ordinal")).alias("o"), "run_id")).alias("b"))
    return best.select("metric", F.col("b.run_id").alias("run_id"))


def sweep_winner(runs: DataFrame) -> DataFrame:
    score = sum((w * F.coalesce(F.col("metrics")[m], F.lit(0.0)) for m, w in SWEEP_WEIGHTS.items()), F.lit(0.0))
    return runs.withColumn("composite", score).orderBy(F.desc("composite"), "ordinal").limit(1)


def sweep_grid(spark, experiment: str, strategies: list[str], top_k: list[int]) -> DataFrame:
    """The cells of a sweep, in order, as runs without metrics yet."""
    if not strategies or not top_k:
        raise ValueError("a sweep needs at least one strategy and one top_k")
    cells = [(f"{s}_k{k}", experiment, {"strategy": s, "top_k": str(k)}, [s, f"k={k}"]) for s in strategies for k in top_k]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "ordinal int, run_name string, experiment_name string, parameters map<string,string>, tags array<string>")
