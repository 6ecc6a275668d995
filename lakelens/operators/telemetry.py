"""Span and trace tables (AG16-AG19, FL7, FL13, SNK8, TP4, AP9, GL7-GL9)."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = "trace_id string, span_id string, parent_span_id string, name string, kind string, attributes map<string,string>, start_time_ns long, end_time_ns long, duration_ms double, status_code string, error_message string, ordinal long"
TRACEPARENT = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
#: Added before rounding, so that ties which floating point leaves undecided always go up.
TIE = 1e-9
#: Rank error of sketches of k = 400.
SKETCH_ERROR = 0.01
SERVICE, SCOPE = "lakelens", "lakelens.tracer"


def tokens(kind: str) -> Column:
    return F.coalesce(F.col("attributes")[f"gen_ai.usage.{kind}_tokens"].try_cast("long"), F.lit(0))


def roll_up(spans: DataFrame) -> DataFrame:
    """One row for each trace. The root is the first exported span without a parent, else the one that starts first."""
    return _rolled(spans.groupBy("trace_id"))


def roll_up_stream(spans: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """The same for a stream of spans with ``ts``: a trace is closed when it had no span for ``gap`` by the watermark.

    Closed traces come out once and leave the state (append mode). Spans behind the watermark are dropped by Spark, which
    counts them in its progress (numRowsDroppedByWatermark); a trace that pauses for longer than ``gap`` is two rows.
    """
    return _rolled(spans.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "trace_id"))


def _rolled(grouped) -> DataFrame:
    order = F.struct(F.col("parent_span_id").isNotNull(), F.when(F.col("parent_span_id").isNotNull(), F.col("start_time_ns")), "ordinal")
    grouped = grouped.agg(
        F.min_by(F.struct("name", "attributes"), order).alias("root"),
        F.count("*").alias("span_count"),
        F.min("start_time_ns").alias("start_time_ns"),
        F.max("end_time_ns").alias("end_time_ns"),
        F.bool_or(F.col("status_code") == "ERROR").alias("failed"),
        F.sum(tokens("prompt")).alias("total_prompt_tokens"),
        F.sum(tokens("completion")).alias("total_completion_tokens"),
    )
    return grouped.select(
        "trace_id",
        F.col("root.name").alias("root_span_name"),
        "span_count",
        F.round((F.col("end_time_ns") - F.col("start_time_ns")) / 1e6, 3).alias("total_duration_ms"),
        "start_time_ns",
        "end_time_ns",
        F.when(F.col("failed"), "ERROR").otherwise("OK").alias("status_code"),
        "total_prompt_tokens",
        "total_completion_tokens",
        (F.col("total_prompt_tokens") + F.col("total_completion_tokens")).alias("total_tokens"),
        F.col("root.attributes").alias("metadata"),
    )


def filter_traces(traces: DataFrame, status: str | None = None, name: str | None = None, min_ms: float | None = None, limit: int = 50) -> DataFrame:
    """Newest first."""
    if status is not None:
        traces = traces.filter(F.col("status_code") == status)
    if name:
        traces = traces.filter(F.lower("root_span_name").contains(name.lower()))
    if min_ms is not None:
        traces = traces.filter(F.col("total_duration_ms") >= min_ms)
    return traces.orderBy(F.desc("start_time_ns"), "trace_id").limit(limit)


def trace_stats(traces: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.coalesce(F.sum((F.col("status_code") == "ERROR").cast("long")), F.lit(0))
    return traces.agg(
        n.alias("total_traces"),
        F.coalesce(F.sum("span_count"), F.lit(0)).alias("total_spans"),
        F.round(F.coalesce(F.avg("total_duration_ms"), F.lit(0.0)) + TIE, 2).alias("avg_duration_ms"),
        F.round(F.coalesce(bad / F.nullif(n, F.lit(0)), F.lit(0.0)) + TIE, 4).alias("error_rate"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )


def newest_traces(spans: DataFrame, keep: int) -> DataFrame:
    """Spans of the ``keep`` traces (ten at least) that arrived last, by first arrival."""
    first = spans.groupBy("trace_id").agg(F.min("ordinal").alias("first")).orderBy(F.desc("first")).limit(max(10, keep))
    return spans.join(first.select("trace_id"), "trace_id", "left_semi")


def latency_percentiles(df: DataFrame, value: str, *by: str, exact: bool = True) -> DataFrame:
    """Linearly interpolated percentiles and the mean, rounded to 0.01.

    Exact ones keep each different value of a group in one buffer; otherwise a sketch of bounded size gives values whose
    rank is off by at most a ten-thousandth of the group.
    """
    at = (lambda p: F.percentile(value, p)) if exact else (lambda p: F.percentile_approx(value, p, 10_000))
    cuts = [F.round(at(p) + TIE, 2).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return df.groupBy(*by).agg(*cuts, F.round(F.avg(value) + TIE, 2).alias("mean"))


def latency_sketches(df: DataFrame, value: str, *by: str, k: int = 400) -> DataFrame:
    """A mergeable quantile sketch (KLL) of ``value`` for each group: some kilobytes that a table can store.

    A quantile of one sketch or of merged ones is off in rank by at most SKETCH_ERROR of the values, with 99 % confidence.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))


def sketched_percentiles(sketches: DataFrame, *by: str) -> DataFrame:
    """p50, p90, p99, mean and n of merged ``sketches``, for any coarser groups than they were made for."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    cuts = [F.kll_sketch_get_quantile_double("s", F.lit(p)).alias(name) for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return merged.select(*by, *cuts, (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"), "n")


def parse_traceparent(header: Column) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(F.lower(F.trim(header)), TRACEPARENT, i), F.lit(""))
    return F.struct(part(1).alias("trace_id"), part(2).alias("span_id"))


def format_traceparent(trace_id: Column, span_id: Column) -> Column:
    return F.concat(F.lit("00-"), trace_id, F.lit("-"), span_id, F.lit("-01"))


def otlp_payload(spans: DataFrame) -> DataFrame:
    """One JSON payload for each trace; every attribute is a string, kind is 1, status 1 or 2."""
    attributes = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        "name",
        F.lit(1).alias("kind"),
        F.col("start_time_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_time_ns").cast("string").alias("endTimeUnixNano"),
        attributes.alias("attributes"),
        F.struct(F.when(F.col("status_code") == "OK", 1).otherwise(2).alias("code"), F.coalesce("error_message", F.lit("")).alias("message")).alias("status"),
        F.col("parent_span_id").alias("parentSpanId"),
    )
    rows = spans.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", span.alias("s")))).alias("x"))
    name = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(SERVICE).alias("stringValue")).alias("value")))
    scopes = F.array(F.struct(F.struct(F.lit(SCOPE).alias("name")).alias("scope"), F.transform("x", lambda y: y["s"]).alias("spans")))
    body = F.struct(F.array(F.struct(F.struct(name.alias("attributes")).alias("resource"), scopes.alias("scopeSpans"))).alias("resourceSpans"))
    return rows.select("trace_id", F.to_json(body).alias("payload"))


_current: ContextVar[tuple[str, str] | None] = ContextVar("lakelens_span", default=None)


class Tracer:
    """Driver-side recorder of nested spans; ``table`` gives them as a DataFrame for the operators above.

    Inside a span, ``values`` are its attributes: ``event`` and ``model_call`` add to them, and ``export`` is called with
    each finished span (``print_span`` for a console).
    """

    def __init__(self, export: Callable[[dict], None] | None = None) -> None:
        self.rows: list[tuple] = []
        self.export = export

    @staticmethod
    def event(values: dict, name: str, **attributes: object) -> None:
        """A named moment of a span, kept as an attribute with its time."""
        values[f"event.{sum(k.startswith('event.') for k in values)}"] = json.dumps({"name": name, "time_ns": time.time_ns(), **{k: str(v) for k, v in attributes.items()}})

    @staticmethod
    def model_call(values: dict, model: str, prompt_tokens: int, completion_tokens: int) -> None:
        values |= {"gen_ai.request.model": model, "gen_ai.usage.prompt_tokens": str(prompt_tokens), "gen_ai.usage.completion_tokens": str(completion_tokens)}

    def trace(self, name: str | None = None, kind: str = "INTERNAL") -> Callable:
        """A decorator that runs a function in a span."""

        def wrap(fn: Callable) -> Callable:
            @functools.wraps(fn)
            def traced(*args, **kwargs):
                with self.span(name or fn.__name__, kind):
                    return fn(*args, **kwargs)

            return traced

        return wrap

    @contextmanager
    def span(self, name: str, kind: str = "INTERNAL", **attributes: object):
        parent = _current.get()
        trace_id, span_id = parent[0] if parent else uuid.uuid4().hex, uuid.uuid4().hex[:16]
        token, values, start, status, error = _current.set((trace_id, span_id)), {k: str(v) for k, v in attributes.items()}, time.time_ns(), "OK", None
        try:
            yield values
        except Exception as raised:
            status, error = "ERROR", str(raised)
            values |= {"exception.type": type(raised).__name__, "exception.message": error}
            raise
        finally:
            _current.reset(token)
            end = time.time_ns()
            row = (trace_id, span_id, parent[1] if parent else None, name, kind, values, start, end, round((end - start) / 1e6, 3), status, error, len(self.rows))
            self.rows.append(row)
            if self.export:
                self.export(dict(zip([c.split()[0] for c in SPAN.split(", ")], row, strict=True)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SPAN)


def print_span(span: dict) -> None:
    """A line for each finished span."""
    print(f"[{span['status_code']}] {span['name']} {span['duration_ms']} ms trace={span['trace_id']} parent={span['parent_span_id']}")


def running_window_counts(df: DataFrame, key: str, micros: str, seconds: float) -> DataFrame:
    """Rows of the same key in the last ``seconds``, the row itself included (WN4)."""
    own = Window.partitionBy(key).orderBy(micros).rangeBetween(-int(seconds * 1_000_000) + 1, 0)
    return df.withColumn("in_window", F.count("*").over(own))
