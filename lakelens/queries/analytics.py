"""Evaluation, experiment, telemetry, limiter, key and relational queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.operators import evaluate, experiments, rag, retrieve, security, telemetry
from lakelens.plans import sqlguard
from lakelens.queries.common import micros, query, table
from lakelens.queries.texts import GT, WHOLE_ITEMS, as_chunks, bigrams_sql, bm25_sql, sql_words, words_sql
from lakelens.session import DEFAULTS, cut, scratch
from lakelens.streaming import limits

EVAL_TOKENS = "list_transform(regexp_extract_all(%s, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))"


def eval_words_sql(column: str) -> str:
    return f"list_filter(list_distinct({EVAL_TOKENS % column}), lambda w: len(w) > 1 AND NOT list_contains({sql_words(T.EVAL_STOPWORDS)}, w))"


def stem_sql(word: str) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{s}') AND length({word}) > {len(s) + 2} THEN {word}[:-{len(s) + 1}]" for s in T.SUFFIXES)
    return f"CASE {cases} ELSE {word} END"


def sentences_sql(text: str) -> str:
    """Sentences of over five characters: lines without list marks are cut at final marks, and pieces after an abbreviation or with a small first letter are put back."""
    lines = f"list_transform(string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(trim(x), '^[-*•]\\s+|\\d+\\.\\s+', '', 'g')))"
    word = "regexp_replace(lower(regexp_extract(x, '(\\S*?)[.!?]+$', 1)), '[^\\p{L}\\p{N}_.]', '', 'g')"
    short = f"(list_contains({sql_words(sorted(T.ABBREVIATIONS))}, {word}) OR list_contains({sql_words(sorted(T.ABBREVIATIONS))}, rtrim({word}, '.')))"
    small = "(lower(left(y, 1)) = left(y, 1) AND upper(left(y, 1)) <> left(y, 1))"
    pieces = "string_split(regexp_replace(z, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1))"
    joined = f"list_reduce({pieces}, lambda x, y: x || CASE WHEN {short} OR {small} THEN ' ' ELSE chr(2) END || y)"
    return f"list_filter(list_transform(flatten(list_transform({lines}, lambda z: string_split({joined}, chr(2)))), lambda x: trim(x)), lambda x: length(x) > 5)"


NUMBERS_SQL = "list_distinct(regexp_extract_all(%s, '\\b\\d+(?:\\.\\d+)?\\b'))"


def metrics_sql(tail: str) -> str:
    """Items with the joined texts of the four documents that rank best for them (rows ctx) and shares of their sentences (rows m)."""
    covered = "len(w) = 0 OR len(list_intersect(w, ct)) / len(w) >= 0.4"
    return bm25_sql(
        asked=WHOLE_ITEMS,
        tail=f""", ctx AS (SELECT item_id, b.text, string_agg(d.text, ' ' ORDER BY k.rank) AS ctx FROM benchmark b LEFT JOIN k ON b.item_id = k.query_id AND k.rank <= 4 LEFT JOIN d ON d.doc_id = k.chunk_id GROUP BY ALL),
    sen AS (SELECT item_id, ctx, unnest({sentences_sql("text")}) AS sentence FROM ctx),
    wrd AS (SELECT item_id, {eval_words_sql("sentence")} AS w, {EVAL_TOKENS % "ctx"} AS ct, {NUMBERS_SQL % "sentence"} AS sn, {NUMBERS_SQL % "ctx"} AS cn FROM sen),
    m AS (SELECT item_id, round(avg(CASE WHEN {covered} THEN 1.0 ELSE 0.0 END), 4) AS recall, round(avg(CASE WHEN len(w) = 0 OR (({covered}) AND len(list_filter(sn, lambda x: NOT list_contains(cn, x))) = 0) THEN 1.0 ELSE 0.0 END), 4) AS faithful FROM wrd GROUP BY item_id),
    o AS (SELECT ctx.item_id AS sample_id, ctx.text, CASE WHEN trim(text) = '' THEN 1.0 WHEN ctx IS NULL THEN 0.0 ELSE coalesce(recall, 1.0) END AS context_recall, CASE WHEN trim(text) = '' OR contains(lower(text), 'insufficient information') OR contains(lower(text), 'not have enough information') THEN 1.0 WHEN ctx IS NULL THEN 0.0 ELSE coalesce(faithful, 1.0) END AS faithfulness FROM ctx LEFT JOIN m ON ctx.item_id = m.item_id)
    {tail}""",
    )


def ranked_documents(spark, sf, k: int):
    """query_id, rank and content of the k documents that BM25 over all documents ranks best for each whole item."""
    docs = as_chunks(spark, sf).select("chunk_id", "content")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieve.bm25_search(queries, docs, k).select("query_id", "chunk_id", "rank")
    return docs.join(F.broadcast(hits) if retrieve.fits(queries, k) else hits, "chunk_id").select("query_id", "rank", "content")


def samples(spark, sf):
    """Items as ground truths; the whole texts of the four documents that BM25 ranks best for them as their contexts."""
    contexts = ranked_documents(spark, sf, 4).groupBy(F.col("query_id").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("ground_truth"))
    texts = F.coalesce(F.transform("c", lambda x: x["content"]), F.array().cast("array<string>"))
    return items.join(contexts, "sample_id", "left").select("sample_id", F.col("ground_truth").alias("query"), F.lit(None).cast("string").alias("answer"), "ground_truth", texts.alias("contexts"))


PRECISION = f"""cp AS (SELECT b.item_id AS sample_id, {eval_words_sql("b.text")} AS gt, k.rank AS pos, {EVAL_TOKENS % "d.text"} AS ct FROM k JOIN benchmark b ON b.item_id = k.query_id JOIN d ON d.doc_id = k.chunk_id WHERE k.rank <= 4),
    rated AS (SELECT *, CASE WHEN len(gt) = 0 OR len(list_intersect(gt, ct)) / len(gt) >= 0.25 THEN 1 ELSE 0 END AS rel FROM cp),
    v AS (SELECT *, sum(rel) OVER (PARTITION BY sample_id ORDER BY pos) / pos AS prec FROM rated),
    pr AS (SELECT item_id AS sample_id, round(coalesce(avg(CASE WHEN rel = 1 THEN prec END), 0), 4) AS context_precision FROM benchmark LEFT JOIN v ON item_id = sample_id GROUP BY item_id)"""


@query("context_precision", bm25_sql(asked=WHOLE_ITEMS, tail=f", {PRECISION} SELECT * FROM pr"))
def context_precision(spark, sf):
    return evaluate.context_precision(samples(spark, sf))


@query("context_recall", metrics_sql("SELECT sample_id, context_recall FROM o"))
def context_recall(spark, sf):
    return evaluate.context_recall(samples(spark, sf))


@query("faithfulness", metrics_sql("SELECT sample_id, faithfulness FROM o"))
def faithfulness(spark, sf):
    return evaluate.faithfulness(samples(spark, sf).withColumn("answer", F.col("ground_truth")))


STEMS_SQL = "list_distinct(list_transform(%s, lambda x: %s))"


@query(
    "evaluation_report",
    metrics_sql(f""", {PRECISION}, rv AS (SELECT sample_id, {STEMS_SQL % (eval_words_sql("text"), stem_sql("x"))} AS st, text FROM o),
    al AS (SELECT faithfulness, context_recall, context_precision, CASE WHEN trim(rv.text) = '' THEN 0.0 WHEN len(st) = 0 THEN 0.75 ELSE 0.95 END AS answer_relevance FROM o JOIN pr USING (sample_id) JOIN rv USING (sample_id)),
    st AS (SELECT unnest([{", ".join(f"struct_pack(metric := '{m}', threshold := CAST({t} AS DOUBLE), x := CAST({m} AS DOUBLE))" for m, t in evaluate.THRESHOLDS.items())}]) AS e FROM al)
    SELECT e.metric AS metric, round(avg(e.x), 4) AS mean, round(min(e.x), 4) AS min, round(max(e.x), 4) AS max, any_value(e.threshold) AS threshold, round(avg(e.x), 4) >= any_value(e.threshold) AND round(avg(e.x), 4) > 0 AS passed FROM st GROUP BY 1"""),
)
def evaluation_report(spark, sf):
    return evaluate.summarize(evaluate.evaluate(cut(samples(spark, sf))))  # read by each metric


def turns(spark, sf):
    rows = table(spark, sf, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    return asked.join(rows.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn"])


@query(
    "answer_relevance",
    f"""WITH p AS (SELECT q.conv_id, q.turn + 1 AS turn, q.text AS query, a.text AS answer FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'),
    w AS (SELECT *, list_distinct(list_transform({eval_words_sql("query")}, lambda x: {stem_sql("x")})) AS qs, list_distinct(list_transform({eval_words_sql("answer")}, lambda x: {stem_sql("x")})) AS s FROM p)
    SELECT conv_id, turn, CASE WHEN trim(query) = '' OR trim(answer) = '' THEN 0.0 WHEN len(qs) = 0 OR len(s) = 0 THEN 0.75 WHEN len(list_intersect(qs, s)) = 0 THEN 0.2 ELSE round(0.60 + 0.35 * len(list_intersect(qs, s)) / len(qs), 4) END AS answer_relevance FROM w""",
)
def answer_relevance(spark, sf):
    rows = turns(spark, sf)
    return rows.select("conv_id", "turn", evaluate.lexical_relevance(F.col("query"), F.col("answer")).alias("answer_relevance"))


@query(
    "metric_summary",
    "WITH v AS (SELECT 'quality' AS metric, CAST(quality AS DOUBLE) AS x, 0.8 AS t FROM labels UNION ALL SELECT 'toxic', CAST(toxic AS DOUBLE), 0.5 FROM labels) "
    "SELECT metric, round(avg(x), 4) AS mean, min(x) AS min, max(x) AS max, CAST(any_value(t) AS DOUBLE) AS threshold, round(avg(x), 4) >= any_value(t) AS passed FROM v GROUP BY metric",
)
def metric_summary(spark, sf):
    return evaluate.summarize(table(spark, sf, "labels"), {"quality": 0.8, "toxic": 0.5})


def priority_runs(spark, sf):
    """Order priorities as runs: average price and share of open orders as metrics, the number of orders as latency."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("price"), F.round(F.avg((F.col("o_orderstatus") == "O").cast("double")), 4).alias("open"), F.count("*").cast("double").alias("total_latency_ms")
    )
    metrics = F.create_map(F.lit("price"), F.col("price"), F.lit("open"), F.col("open"))
    return rows.select("run_id", F.substring("run_id", 1, 1).cast("int").alias("ordinal"), metrics.alias("metrics"), "total_latency_ms")


RUNS = """WITH r AS (SELECT o_orderpriority AS run_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS ordinal, round(avg(o_totalprice), 2) AS price, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 4) AS open, CAST(count(*) AS DOUBLE) AS total_latency_ms FROM orders GROUP BY 1),
v AS (SELECT run_id, ordinal, 'price' AS metric, price AS x FROM r UNION ALL SELECT run_id, ordinal, 'open', open FROM r UNION ALL SELECT run_id, ordinal, 'total_latency_ms', total_latency_ms FROM r)"""


@query(
    "run_comparison",
    RUNS
    + """ SELECT v.run_id, v.metric, round(b.x, 4) AS baseline_val, round(v.x, 4) AS candidate_val, round(v.x - b.x, 4) AS absolute_delta, CASE WHEN b.x <> 0 THEN round(round(v.x - b.x, 4) / b.x * 100, 2) ELSE 0 END AS percentage_delta,
    CASE WHEN v.metric = 'total_latency_ms' THEN v.x < b.x ELSE v.x > b.x END AS improved FROM v JOIN v b ON v.metric = b.metric AND b.run_id = '3-MEDIUM' WHERE v.run_id <> '3-MEDIUM'""",
)
def run_comparison(spark, sf):
    return experiments.compare_runs(priority_runs(spark, sf), "3-MEDIUM")


@query("run_leaders", RUNS + " SELECT metric, run_id FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'total_latency_ms' THEN -x ELSE x END DESC, ordinal) AS n FROM v) WHERE n = 1")
def run_leaders(spark, sf):
    return experiments.leaders(priority_runs(spark, sf))


def spans(spark, sf, events=None):
    """Events as spans: a user's events of one day are a trace; the value is the span's milliseconds."""
    start = micros("ts") * 1000
    rows = (table(spark, sf, "events") if events is None else events).withColumn("at", start)
    trace = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    tokens = F.create_map(F.lit("gen_ai.usage.prompt_tokens"), F.get_json_object("props", "$.k"), F.lit("gen_ai.usage.completion_tokens"), F.lit("1"))
    return rows.select(
        trace.alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.when(F.col("event_id") % 3 != 0, F.lit("parent")).alias("parent_span_id"),
        F.col("event_type").alias("name"),
        tokens.alias("attributes"),
        F.col("at").alias("start_time_ns"),
        (F.col("at") + F.floor(F.col("value") * 1000) * 1000).alias("end_time_ns"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status_code"),
        F.col("event_id").alias("ordinal"),
    )


TRACES = """WITH s AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id, event_type, epoch_us(ts) * 1000 AS st, epoch_us(ts) * 1000 + CAST(floor(value * 1000) AS BIGINT) * 1000 AS en, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT trace_id, arg_min(event_type, (CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END, CASE WHEN event_id % 3 <> 0 THEN st ELSE 0 END, event_id)) AS root_span_name, count(*) AS span_count, round((max(en) - min(st)) / 1e6, 3) AS total_duration_ms, min(st) AS start_time_ns, max(en) AS end_time_ns,
CASE WHEN bool_or(event_type = 'error') THEN 'ERROR' ELSE 'OK' END AS status_code, CAST(sum(coalesce(k, 0)) AS BIGINT) AS total_prompt_tokens, count(*) AS total_completion_tokens, CAST(sum(coalesce(k, 0)) + count(*) AS BIGINT) AS total_tokens FROM s GROUP BY trace_id)"""


@query("trace_rollup", TRACES + " SELECT * FROM t")
def trace_rollup(spark, sf):
    return telemetry.roll_up(spans(spark, sf)).drop("metadata")


def event_stream(spark, sf):
    """The events table as a stream of its files; its state stores need RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, DEFAULTS[key])
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/event[s].parquet")


def streamed(rows, name: str):
    """What a stream gives when it is run to the end of its files."""
    folder = scratch(rows.sparkSession, name)
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{folder}/out")


@query(
    "trace_rollup_stream",
    TRACES + ", w AS (SELECT max(st) - 600000000000 AS seen FROM s), last AS (SELECT trace_id, max(st) + 86400000000000 AS closes FROM s GROUP BY trace_id) SELECT t.* FROM t JOIN last USING (trace_id) CROSS JOIN w WHERE closes <= seen",
)
def trace_rollup_stream(spark, sf):
    """Traces of a stream of spans that were closed by the watermark, ten minutes behind the newest span; a day closes a trace."""
    rows = spans(spark, sf, event_stream(spark, sf)).withColumn("ts", F.timestamp_micros((F.col("start_time_ns") / 1000).cast("long")))
    return streamed(telemetry.roll_up_stream(rows, "1 day", "10 minutes").drop("metadata"), "traces")


@query("trace_filter", TRACES + " SELECT trace_id, root_span_name, total_duration_ms FROM t WHERE status_code = 'ERROR' AND contains(lower(root_span_name), 'c') AND total_duration_ms >= 1 ORDER BY start_time_ns DESC, trace_id LIMIT 50")
def trace_filter(spark, sf):
    found = telemetry.filter_traces(telemetry.roll_up(spans(spark, sf)), "ERROR", "C", 1.0, 50)
    return found.select("trace_id", "root_span_name", "total_duration_ms")


@query("trace_stats", TRACES + " SELECT count(*) AS total_traces, CAST(sum(span_count) AS BIGINT) AS total_spans, round(avg(total_duration_ms) + 1e-9, 2) AS avg_duration_ms, round(avg(CASE WHEN status_code = 'ERROR' THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS error_rate, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM t")
def trace_stats(spark, sf):
    return telemetry.trace_stats(telemetry.roll_up(spans(spark, sf)))


OTLP_SPAN = """'{"traceId":"' || trace_id || '","spanId":"' || event_id || '","name":"' || event_type || '","kind":1,"startTimeUnixNano":"' || st || '","endTimeUnixNano":"' || en || '","attributes":['
    || '{"key":"gen_ai.usage.prompt_tokens","value":{' || coalesce('"stringValue":"' || k || '"', '') || '}},{"key":"gen_ai.usage.completion_tokens","value":{"stringValue":"1"}}],"status":{"code":'
    || CASE WHEN event_type = 'error' THEN 2 ELSE 1 END || ',"message":""}' || CASE WHEN event_id % 3 <> 0 THEN ',"parentSpanId":"parent"' ELSE '' END || '}'"""


@query(
    "otlp_payloads",
    TRACES
    + f""" SELECT trace_id, '{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":"lakelens"}}}}]}},"scopeSpans":[{{"scope":{{"name":"lakelens.tracer"}},"spans":['
    || string_agg({OTLP_SPAN}, ',' ORDER BY event_id) || ']}}]}}]}}' AS payload FROM s GROUP BY trace_id""",
)
def otlp_payloads(spark, sf):
    return telemetry.otlp_payload(spans(spark, sf).withColumn("error_message", F.lit(None).cast("string")))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5) + 1e-9, 2) AS p50, round(quantile_cont(value, 0.9) + 1e-9, 2) AS p90, round(quantile_cont(value, 0.99) + 1e-9, 2) AS p99, round(avg(value) + 1e-9, 2) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return telemetry.latency_percentiles(table(spark, sf, "events"), "value", "event_type")


def requests(spark, sf):
    """Events as requests: each user's events, an hour of the log counting as a second of the limiter's time."""
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client_key"), "event_id", (micros("ts") / 3.6e9).alias("at"))


ADMISSION = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client_key, event_id, epoch_us(ts) / 3.6e9 AS "at", row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (SELECT '' AS client_key, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS "at", CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS recent, true AS allowed, 0 AS remaining, 0 AS retry_after
    UNION ALL SELECT client_key, event_id, "at", n, CASE WHEN burst OR full_ THEN kept ELSE list_append(kept, "at") END, NOT (burst OR full_),
        CASE WHEN burst OR full_ THEN 0 ELSE CAST(5 - len(kept) - 1 AS INTEGER) END, CASE WHEN burst THEN 1 WHEN full_ THEN greatest(1, CAST(trunc(60.0 - ("at" - kept[1])) AS INTEGER)) ELSE 0 END
    FROM (SELECT *, len(list_filter(kept, lambda t: t > "at" - 1.0)) >= 2 AS burst, len(kept) >= 5 AS full_ FROM (
        SELECT e.*, list_filter(CASE WHEN e.n = 1 THEN CAST([] AS DOUBLE[]) ELSE r.recent END, lambda t: t > e."at" - 60.0) AS kept FROM r JOIN e ON e.n = r.n + 1 AND (e.n = 1 OR e.client_key = r.client_key))))
SELECT client_key, event_id, "at", allowed, remaining, retry_after FROM r WHERE n > 0"""


@query("rate_limit_admission", ADMISSION)
def rate_limit_admission(spark, sf):
    return limits.admit_batch(requests(spark, sf), limit=5, burst=2, window=60.0)


@query("rate_window_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("us", micros("ts"))
    return telemetry.running_window_counts(rows, "user_id", "us", 3600).select("event_id", "in_window")


@query("rate_limit_stream", ADMISSION)
def rate_limit_stream(spark, sf):
    """The streaming limiter over the table as a stream, run to its end; its state store needs RocksDB."""
    rows = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("client_key"), "event_id", (micros("ts") / 3.6e9).alias("at"))
    return streamed(limits.admit_stream(rows, limit=5, burst=2), "limits")


CACHE = """WITH RECURSIVE e AS (SELECT event_type AS c, user_id AS k, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS i, row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY c, k ORDER BY i) AS before FROM e),
d AS (SELECT p.c, p.k, p.n, p.t, p.before IS NOT NULL AND count(DISTINCT x.k) < 64 AS kept FROM p LEFT JOIN e x ON x.c = p.c AND x.i > p.before AND x.i < p.i GROUP BY p.c, p.k, p.n, p.t, p.before),
r AS (SELECT c, k, n, t AS since, false AS hit, kept FROM d WHERE n = 1 UNION ALL SELECT d.c, d.k, d.n, CASE WHEN d.kept AND d.t <= r.since + 86400 THEN r.since ELSE d.t END, d.kept AND d.t <= r.since + 86400, d.kept FROM r JOIN d ON d.c = r.c AND d.k = r.k AND d.n = r.n + 1)
SELECT c AS cache_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, greatest(0, count(*) FILTER (NOT kept) - 64) AS evictions, least(64, count(*) FILTER (NOT kept)) AS size, round(count(*) FILTER (hit) / count(*), 4) AS hit_ratio FROM r GROUP BY c"""


@query("cache_hit_ratio", CACHE)
def cache_hit_ratio(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("cache_id"), F.col("user_id").alias("key"), (micros("ts") / 1e6).alias("at"), F.col("event_id").alias("seq"))
    return limits.simulate_cache(rows, capacity=64, ttl=86_400.0)


NOW = datetime(2024, 1, 1)


@query(
    "key_validation",
    """WITH r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN 'ea_unknown' ELSE 'ea_' || (c_custkey % 60) END AS raw, CASE WHEN c_custkey % 2 = 0 THEN 'rag:query' END AS wanted FROM customer),
    k AS (SELECT i AS key_id, sha256('ea_' || i) AS h, CASE i % 5 WHEN 0 THEN ['admin'] WHEN 1 THEN ['rag:query', 'sql:query'] ELSE ['sql:query'] END AS scopes, CASE i % 6 WHEN 0 THEN 'revoked' WHEN 1 THEN 'expired' WHEN 2 THEN 'rotating' ELSE 'active' END AS status, i % 4 = 0 AS late, i % 8 = 2 AS grace_late FROM range(60) t(i))
    SELECT request_id, CAST(key_id AS VARCHAR) AS key_id, CASE WHEN trim(raw) = '' THEN 'MISSING_KEY' WHEN key_id IS NULL THEN 'INVALID_KEY' WHEN status = 'revoked' THEN 'REVOKED_KEY' WHEN status = 'expired' THEN 'EXPIRED_KEY' WHEN status = 'rotating' AND grace_late THEN 'GRACE_PERIOD_EXPIRED'
    WHEN status <> 'rotating' AND late THEN 'EXPIRED_KEY' WHEN wanted IS NOT NULL AND NOT (list_contains(scopes, 'admin') OR list_contains(scopes, wanted)) THEN 'INSUFFICIENT_SCOPE' END AS error_code FROM r LEFT JOIN k ON sha256(trim(raw)) = h""",
)
def key_validation(spark, sf):
    asked = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.expr("case when c_custkey % 11 = 0 then '  ' when c_custkey % 7 = 0 then 'ea_unknown' else concat('ea_', c_custkey % 60) end").alias("raw_key"),
        F.expr("case when c_custkey % 2 = 0 then 'rag:query' end").alias("required_scope"),
    )
    keys = spark.range(60).selectExpr(
        "cast(id as string) key_id",
        "sha2(concat('ea_', id), 256) key_hash",
        "case id % 5 when 0 then array('admin') when 1 then array('rag:query', 'sql:query') else array('sql:query') end scopes",
        "case id % 6 when 0 then 'revoked' when 1 then 'expired' when 2 then 'rotating' else 'active' end status",
        "if(id % 4 = 0, timestamp'2023-06-01', timestamp'2024-06-01') expires_at",
        "if(id % 8 = 2, timestamp'2023-06-01', timestamp'2024-06-01') grace_expires_at",
    )
    return security.validate_keys(asked, keys, F.lit(NOW).cast("timestamp")).select("request_id", "key_id", "error_code")


CLAIM = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(sentence, '(?i)\\[(?:Source|Doc)s?\\s*(?::\\s*)?([0-9\\s,]+(?:and\\s*\\d+)?)\\]', '', 'g'), '\\s+([.,!?;:])', '\\1', 'g'), '\\s+', ' ', 'g')), '^ | $', '')"
GROUND_NUMBERS = "list_distinct(regexp_extract_all(lower(%s), '\\b\\d+(?:\\.\\d+)?\\b|\\$\\d+'))"


@query(
    "verify_answers",
    bm25_sql(
        asked=WHOLE_ITEMS,
        tail=f""", an AS (SELECT item_id AS answer_id, text || ' It holds [Source 1]. This one is invented entirely [Source 2].' AS answer FROM benchmark),
    se AS (SELECT answer_id, unnest({sentences_sql("answer")}) AS sentence, generate_subscripts({sentences_sql("answer")}, 1) AS no FROM an),
    cl AS (SELECT answer_id, no, {CLAIM} AS claim, CASE WHEN contains(sentence, '[Source 1]') THEN 1 WHEN contains(sentence, '[Source 2]') THEN 2 END AS source_index FROM se),
    jo AS (SELECT cl.*, d.text AS content FROM cl LEFT JOIN k ON k.query_id = answer_id AND k.rank = source_index LEFT JOIN d ON d.doc_id = k.chunk_id),
    fe AS (SELECT *, {words_sql("claim")} AS cw, {words_sql("content")} AS dw, {GT % "claim"} AS ct, {GT % "content"} AS dt, {GROUND_NUMBERS % "claim"} AS cn, {GROUND_NUMBERS % "content"} AS dn FROM jo),
    bi AS (SELECT *, {bigrams_sql("ct")} AS cb, {bigrams_sql("dt")} AS db FROM fe),
    gr AS (SELECT *, CASE WHEN content IS NULL THEN NULL WHEN len(cw) = 0 THEN 1.0 ELSE round((0.55 * len(list_intersect(cw, dw)) / len(cw) + 0.25 * len(list_intersect(cw, dw)) / len(list_distinct(list_concat(cw, dw))) + 0.20 * coalesce(len(list_intersect(cb, db)) / nullif(len(cb), 0), 0))
        * (0.5 + 0.5 * CASE WHEN len(cn) > 0 THEN len(list_intersect(cn, dn)) / len(cn) ELSE 1.0 END), 4) END AS score FROM bi),
    su AS (SELECT answer_id, count(*) AS total_claims, CAST(sum(CASE WHEN coalesce(score, 0) >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS grounded_claims, CAST(sum(CASE WHEN content IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unattributed_claims FROM gr GROUP BY answer_id)
    SELECT *, round(grounded_claims / total_claims, 4) AS faithfulness_score, CASE WHEN round(grounded_claims / total_claims, 4) >= 0.8 THEN 'verified' WHEN round(grounded_claims / total_claims, 4) >= 0.4 THEN 'partially_grounded' ELSE 'unverified' END AS grounding_status FROM su""",
    ),
)
def verify_answers(spark, sf):
    """Items answered by their own words with citations of the two documents that BM25 ranks best for each."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("item_id").alias("query_id"), F.concat("text", F.lit(" It holds [Source 1]. This one is invented entirely [Source 2].")).alias("answer"))
    sources = ranked_documents(spark, sf, 2).select("query_id", F.col("rank").cast("int").alias("source_index"), "content")
    return rag.verify_answers(items, sources)


SQL_QUERIES = {
    "sql_join_group_having": "SELECT n_name, count(*) AS n_customers, round(avg(c_acctbal), 6) AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3 ORDER BY avg_balance DESC",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n, round(sum(total), 2) AS total FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 100000 GROUP BY c_mktsegment",
    "sql_window": "SELECT l_orderkey, l_linenumber, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS place, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem",
    "sql_setops": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "sql_semi_anti": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "sql_topk": "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_case_dates": "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY year(o_orderdate)",
}


def guarded(name: str, sql: str):
    tables = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if f" {t} " in f" {sql} ".replace(")", " ")]
    oracle = sql.replace("sum(CASE", "CAST(sum(CASE").replace("END) AS high", "END) AS BIGINT) AS high") if "AS high" in sql else sql

    @query(name, oracle)
    def run(spark, sf):
        for t in tables:
            table(spark, sf, t).createOrReplaceTempView(t)
        return sqlguard.run(spark, sql)


for _name, _sql in SQL_QUERIES.items():
    guarded(_name, _sql)


REFLECTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in REFLECTED)


@query(
    "schema_reflection",
    f"""SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END AS type,
    is_nullable = 'YES' AS nullable, n AS row_count FROM information_schema.columns JOIN ({COUNTS}) ON t = table_name""",
)
def schema_reflection(spark, sf):
    return sqlguard.reflected({n: table(spark, sf, n) for n in REFLECTED})


SESSIONS = """WITH g AS (SELECT user_id, epoch_us(ts) AS us, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) < 7200000000 THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nth FROM g),
    r AS (SELECT user_id, nth, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, nth)"""


def session_columns(found):
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 4).alias("total"))


@query("event_sessions", SESSIONS + " SELECT user_id, start_us, end_us, n, total FROM r")
def event_sessions(spark, sf):
    """Each user's runs of events less than two hours apart."""
    rows = table(spark, sf, "events").withColumn("ts", F.timestamp_micros(micros("ts")))
    return session_columns(limits.event_sessions(rows, "2 hours", "10 minutes", "user_id"))


@query("event_sessions_stream", SESSIONS + ", w AS (SELECT max(us) - 600000000 AS seen FROM g) SELECT user_id, start_us, end_us, n, total FROM r CROSS JOIN w WHERE end_us <= seen")
def event_sessions_stream(spark, sf):
    """The same of a stream: sessions that the watermark has closed."""
    rows = event_stream(spark, sf).withColumn("ts", F.timestamp_micros(micros("ts")))
    return session_columns(streamed(limits.event_sessions(rows, "2 hours", "10 minutes", "user_id"), "sessions"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    got = limits.event_windows(table(spark, sf, "events"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
