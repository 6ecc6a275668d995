"""One object over a store of tables: each service call as a library function on DataFrames.

The store is a folder of Parquet tables: documents, chunks, vectors, runs, keys. Writes add batches or new versions
(``lakelens.sources.store``), so no table is overwritten in place.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions import models
from lakelens.functions import text as T
from lakelens.functions import vectors as V
from lakelens.operators import agent, chunking, evaluate, experiments, guardrails, rag, retrieve, router, security, telemetry, transform
from lakelens.plans import sqlguard
from lakelens.session import cut
from lakelens.sources import files
from lakelens.sources import store as tables
from lakelens.streaming import ingest

Embedder = Callable[[Column], Column]


class Engine:
    def __init__(self, spark: SparkSession, store: str, dims: int = 768, embed: Embedder | None = None, model: Callable[[str], str] | None = None, batch_model: models.BatchModel | None = None):
        self.spark, self.store, self.dims = spark, store.rstrip("/"), dims
        self.embed = embed or (lambda text: V.hash_embedding(text, dims))
        self.model = model or (lambda prompt: f"[MOCK RESPONSE] Processed query: '{prompt}'. Result: Mock result.")
        self.batch_model = batch_model or models.each(self.model)
        self.tracer = telemetry.Tracer()

    # tables

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.store, name)

    def has(self, name: str) -> bool:
        return tables.has(self.spark, self.store, name)

    def replace(self, name: str, rows: DataFrame) -> None:
        tables.replace(rows, self.store, name)

    def append(self, name: str, rows: DataFrame) -> None:
        tables.append(rows, self.store, name, uuid.uuid4().hex)

    def queries(self, *texts: str) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        return rows.withColumn("embedding", self.embed(F.col("query")))

    # documents

    def ingest_text(self, text: str, title: str = "", source: str = "", document_id: str | None = None) -> str:
        document_id = document_id or str(uuid.uuid4())
        self.ingest(self.spark.createDataFrame([(document_id, text, title, source)], "document_id string, content string, title string, source string"))
        return document_id

    def ingest(self, docs: DataFrame) -> None:
        ingest.ingest_batch(docs, self.store)

    def ingest_folder(self, folder: str) -> dict:
        rows = files.scan_directory(self.spark, folder).drop("checksum", "sections", "pages", "path")
        self.ingest(rows)
        self.index()
        done = rows.agg(F.count("*"), F.array_sort(F.collect_set("department"))).first()
        return {"documents": done[0], "departments": done[1], "chunks": self.table("chunks").count(), "vectors": self.table("vectors").count()}

    def index(self) -> None:
        """Vectors of chunks that have none yet or whose content changed; the last write of a chunk wins."""
        chunks = self.table("chunks")
        if not self.has("vectors"):
            return self.append("vectors", chunks.withColumn("embedding", self.embed(F.col("content"))))
        stored = self.table("vectors")
        new = cut(chunks.join(stored.select("chunk_id", "chunk_hash"), ["chunk_id", "chunk_hash"], "left_anti").select(*chunks.columns).withColumn("embedding", self.embed(F.col("content"))))
        if stored.join(new.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
            self.append("vectors", new)
        else:
            self.replace("vectors", files.upsert(stored, new))

    def documents(self) -> DataFrame:
        return chunking.document_summary(self.table("documents"), self.table("chunks"))

    def chunks(self, document_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("document_id") == document_id).orderBy("chunk_index")

    def delete(self, document_id: str) -> int:
        """Removes a document from all tables; gives the number of its chunks."""
        gone = self.spark.createDataFrame([(document_id,)], "document_id string")
        n = self.chunks(document_id).count()
        for name in ("documents", "chunks", "vectors"):
            if self.has(name):
                self.replace(name, files.delete_documents(self.table(name), gone))
        return n

    def clear(self) -> None:
        for name in ("documents", "chunks", "vectors"):
            if self.has(name):
                self.replace(name, self.table(name).filter("false"))

    # search

    def search(self, *texts: str, strategy: str = "hybrid", k: int = 5, where: Column | None = None, min_score: float = 0.0, **weights: float) -> DataFrame:
        if not 1 <= k <= 100:
            raise ValueError("k must be between 1 and 100")
        find = {"semantic": retrieve.dense_search, "sparse": retrieve.bm25_search, "hybrid": retrieve.hybrid_search}[strategy]
        return find(self.queries(*texts), self.table("vectors"), k, where=where, min_score=min_score, **weights)

    def rerank(self, *texts: str, strategy: str = "hybrid", k: int = 5, candidate_k: int = 25, where: Column | None = None) -> DataFrame:
        return retrieve.two_stage(self.queries(*texts), self.table("vectors"), k, candidate_k, strategy, where)

    def transformed_search(self, query: str, mode: str, answer: str, k: int = 5) -> DataFrame:
        """hyde, multi_query or step_back over a model's answer to the transformation prompt."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return transform.transformed_search(asked, self.table("vectors"), mode, lambda prompts: [answer] * len(prompts), self.embed, k, rerank=False)

    def rag(self, *texts: str, k: int = 5, max_tokens: int = 4000, where: Column | None = None) -> DataFrame:
        queries = self.queries(*texts)
        found = retrieve.dense_search(queries, self.table("vectors"), k, where)
        rows = F.broadcast(found) if retrieve.fits(queries, k) else found
        rows = rows.join(self.table("vectors").select("chunk_id", "document_id", "source", "content"), "chunk_id")
        return rag.rag_query(queries, rows, max_tokens, lambda prompt: models.answers(self.batch_model, prompt))

    # routing and agent

    def classify(self, *texts: str) -> DataFrame:
        return router.cascade(self.queries(*texts).drop("embedding"))

    def tools(self) -> agent.Registry:
        def knowledge(query: str = "", top_k: int = 5, **_) -> str:
            found = self.rerank(query, k=max(1, min(10, int(top_k))), candidate_k=max(4 * int(top_k), 15))
            return "\n\n".join(r["content"] for r in found.orderBy("final_rank").collect()) or "No matching documents."

        def sql(query: str = "", **_) -> str:
            got = sqlguard.execute(self.spark, query)
            return agent.markdown_table(got.columns, got.rows)

        extra = [
            agent.Tool("knowledge_search", "Search the indexed documents.", {"query": "string", "top_k": "integer"}, knowledge),
            agent.Tool("sql_query", "Run one read-only SELECT.", {"query": "string"}, sql),
            agent.Tool("sql_schema", "Describe the tables.", {}, lambda **_: str(self.schema())),
        ]
        return agent.Registry(*agent.basic_tools(), *extra)

    def agent(self, query: str, max_iterations: int = agent.MAX_ITERATIONS) -> str:
        with self.tracer.span("agent.run", "AGENT", query=query):
            return agent.run_agent(query, self.model, self.tools(), max_iterations)[0]

    def dispatch(self, query: str, intent: str | None = None) -> tuple[str, object]:
        """(target, answer); a forced intent skips classification."""
        asked = self.classify(query) if intent is None else self.queries(query).withColumn("intent", F.lit(intent))
        target = asked.select(router.dispatch_target(F.col("intent"), F.col("query")).alias("target")).first()["target"]
        run = {"chat": self.model, "rag": lambda q: self.rag(q, k=4).first()["answer"], "sql": lambda q: sqlguard.execute(self.spark, q), "agent": self.agent}[target]
        return target, run(query)

    # guardrails, SQL, evaluation, experiments, keys, telemetry

    def validate(self, *texts: str) -> DataFrame:
        return guardrails.inspect_input(self.spark.createDataFrame([(t,) for t in texts], "text string"))

    def redact(self, *texts: str) -> DataFrame:
        return guardrails.inspect_pii(self.spark.createDataFrame([(t,) for t in texts], "text string"))

    def sql(self, query: str, max_rows: int | None = None) -> sqlguard.Result:
        return sqlguard.execute(self.spark, query, max_rows)

    def schema(self, only: list[str] | None = None) -> list[dict]:
        names = [t.name for t in self.spark.catalog.listTables()]
        return sqlguard.reflect({n: self.spark.table(n) for n in names}, only)

    def evaluate(self, samples: DataFrame) -> DataFrame:
        return evaluate.summarize(evaluate.evaluate(samples))

    def log_run(self, row: tuple) -> None:
        """Append a version of a run: (run_id, experiment_name, run_name, parameters, metrics, tags, status, total_latency_ms, created_at, ordinal, version)."""
        schema = "run_id string, experiment_name string, run_name string, parameters map<string,string>, metrics map<string,double>, tags array<string>, status string, total_latency_ms double, created_at string, ordinal int, version long"
        self.append("runs", self.spark.createDataFrame([row], schema))

    def run(self, run_id: str) -> DataFrame:
        return experiments.latest(self.table("runs")).filter(F.col("run_id") == run_id)

    def update_run(self, run_id: str, **changes) -> None:
        """A new version of a run with other values in some columns."""
        old = self.run(run_id)
        kinds = dict(old.dtypes)
        self.append("runs", old.withColumns({c: F.lit(v).cast(kinds[c]) if not isinstance(v, dict) else F.create_map(*(F.lit(x) for kv in v.items() for x in kv)).cast(kinds[c]) for c, v in changes.items()}).withColumn("version", F.col("version") + 1))

    def delete_run(self, run_id: str) -> None:
        self.replace("runs", self.table("runs").filter(F.col("run_id") != run_id))

    def sweep(self, experiment: str, strategies: list[str], top_k: list[int], run: Callable[[str, int], dict[str, float]], created_at: str) -> DataFrame:
        """Run every cell of a grid, log it with its metrics and give the winner."""
        cells = experiments.sweep_grid(self.spark, experiment, strategies, top_k).orderBy("ordinal").collect()  # a grid's cells
        for c in cells:
            start = time.perf_counter()
            metrics = run(c["parameters"]["strategy"], int(c["parameters"]["top_k"]))
            row = (f"{experiment}-{c['run_name']}", experiment, c["run_name"], c["parameters"], metrics, c["tags"], "completed", (time.perf_counter() - start) * 1000, created_at, c["ordinal"], 1)
            self.log_run(row)
        return experiments.sweep_winner(self.runs(experiment, len(cells)))

    def runs(self, experiment: str | None = None, limit: int = 50) -> DataFrame:
        return experiments.list_runs(experiments.latest(self.table("runs")), experiment, limit)

    def create_key(self, name: str, scopes: list[str], now: datetime) -> str:
        raw, row = security.new_key(self.spark, name, scopes, now)
        self.append("keys", row)
        return raw

    def keys(self) -> DataFrame:
        return experiments.latest(self.table("keys"), "key_id")

    def revoke_key(self, key_id: str) -> None:
        self.append("keys", security.revoke_key(self.keys(), key_id))

    def rotate_key(self, key_id: str, now: datetime, grace_hours: int = security.GRACE_HOURS) -> str:
        raw, rows = security.rotate_key(self.spark, self.keys(), key_id, now, grace_hours)
        self.append("keys", rows)
        return raw

    def traces(self, **filters) -> DataFrame:
        return telemetry.filter_traces(telemetry.roll_up(self.tracer.table(self.spark)), **filters)

    def trace(self, trace_id: str) -> DataFrame:
        """The spans of a trace, in order."""
        return self.tracer.table(self.spark).filter(F.col("trace_id") == trace_id).orderBy("ordinal")

    def clear_traces(self) -> None:
        self.tracer.rows.clear()

    def token_estimates(self) -> DataFrame:
        return self.table("chunks").select("chunk_id", T.estimate_tokens(F.col("content")).alias("tokens"))
