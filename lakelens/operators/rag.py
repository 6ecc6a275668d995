"""Context packing, prompts, citations and grounding (WN3, RG1-RG4, TK9, JN5, AG4, AG5, AP4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions import text as T
from lakelens.functions import vectors as V

# ---- fixed values: texts and thresholds that decide results ----
INSUFFICIENT = "Based on the provided documentation, I do not have enough information to answer this question."
INSUFFICIENT_MARKS = ("insufficient information", "do not have enough information")
NO_CONTEXT = "[NO CONTEXT AVAILABLE]"
USER_PROMPT = "Context Documentation:\n---------------------\n%s\n---------------------\n\nUser Question: %s\n\nPlease provide a grounded answer based strictly on the context above."
TRUNCATED = "... [Truncated to fit context window]\n"
GROUNDED, PARTIAL, VERIFIED = 0.40, 0.40, 0.80
# ---- end of fixed values ----


def context_blocks(results: DataFrame, max_tokens: int = 4000, chars_per_token: float = 4.0) -> DataFrame:
    """Blocks of each query that fit the budget: all before the first overflow; a first block too long is cut.

    Results carry query_id, rank, document_id, source, content; page and section are used where they are columns.
    """
    piece = lambda c, label: F.coalesce(F.concat(F.lit(f" | {label}: "), F.nullif(F.col(c).cast("string"), F.lit(""))), F.lit("")) if c in results.columns else F.lit("")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    header = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | Document: "), F.col("document_id").cast("string"), F.lit(" | File: "), F.coalesce(F.nullif("source", F.lit("")), F.col("document_id").cast("string")), piece("page", "Page"), piece("section", "Section"), F.lit("]"))
    rows = results.withColumn("header", header).withColumn("block", F.concat("header", F.lit("\n"), strip(F.col("content")), F.lit("\n")))
    rows = rows.withColumn("block_tokens", T.estimate_tokens(F.col("block")))
    own = Window.partitionBy("query_id").orderBy("rank")
    upto = F.sum("block_tokens").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto)  # totals only grow, so the first overflow and all after it are over the budget
    limit = int(max_tokens * chars_per_token)
    head = F.substring("content", 1, limit)
    kept = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)
    first_cut = (F.col("rank") == 1) & (F.col("upto") > max_tokens)
    rows = rows.withColumn("block", F.when(first_cut, F.concat("header", F.lit("\n"), strip(kept), F.lit(TRUNCATED))).otherwise(F.col("block"))).withColumn("content", F.when(first_cut, kept).otherwise(F.col("content")))
    return rows.filter((F.col("upto") <= max_tokens) | first_cut).drop("header", "upto")


def assemble_context(results: DataFrame, max_tokens: int = 4000) -> DataFrame:
    blocks = context_blocks(results, max_tokens).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return blocks.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"), F.size("b").alias("n_sources"))


def user_prompt(context: Column, query: Column) -> Column:
    context = F.coalesce(F.nullif(F.trim(context), F.lit("")), F.lit(NO_CONTEXT))
    return F.format_string(USER_PROMPT, context, F.trim(query))


def mock_answer(prompt: Column, result: str = "Mock result.") -> Column:
    """Deterministic stand-in for a language model."""
    return F.concat(F.lit("[MOCK RESPONSE] Processed query: '"), prompt, F.lit(f"'. Result: {result}"))


def rag_query(queries: DataFrame, found: DataFrame, max_tokens: int = 4000, model=mock_answer) -> DataFrame:
    """(query_id, answer, context) from retrieved rows; a query that found nothing gets the fixed answer."""
    context = assemble_context(found, max_tokens)
    rows = queries.select("query_id", "query").join(context, "query_id", "left")
    answer = F.when(F.col("context").isNull(), F.lit(INSUFFICIENT)).otherwise(model(user_prompt(F.col("context"), F.col("query"))))
    return rows.select("query_id", "query", "context", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), answer.alias("answer"))


def grounding_features(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a struct of a text's content words, token bigrams and numbers, so that a join repeats no tokenizing."""
    value = F.col(text)
    rows = df.select("*", T.grounding_tokens(value).alias("_t"))
    words = T.content_words(F.col("_t"), T.STOPWORDS)
    return rows.select("*", F.struct(words.alias("words"), T.bigrams(F.col("_t")).alias("bigrams"), T.grounding_numbers(value).alias("numbers")).alias(name)).drop("_t")


def grounding_of(claim: str, content: str) -> Column:
    """Recall, Jaccard and bigram overlap of a claim's features in a content's, scaled by the claim's numbers found."""
    c, d = F.col(claim), F.col(content)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    def score(shared: Column) -> Column:
        union = F.size(c["words"]) + F.size(d["words"]) - shared
        base = 0.55 * ratio(shared, F.size(c["words"])) + 0.25 * ratio(shared, union) + 0.20 * ratio(F.size(F.array_intersect(c["bigrams"], d["bigrams"])), F.size(c["bigrams"]))
        numbers = F.when(F.size(c["numbers"]) > 0, F.size(F.array_intersect(c["numbers"], d["numbers"])) / F.size(c["numbers"])).otherwise(F.lit(1.0))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(base * (0.5 + 0.5 * numbers), 4)))

    return F.when(F.size(c["words"]) == 0, F.lit(1.0)).otherwise(V.let(F.size(F.array_intersect(c["words"], d["words"])), score))


def with_grounding(pairs: DataFrame, claim: str = "claim", content: str = "content") -> DataFrame:
    """Adds grounding_score to rows that hold both texts."""
    rows = grounding_features(grounding_features(pairs, claim, "_claim"), content, "_chunk")
    return rows.withColumn("grounding_score", grounding_of("_claim", "_chunk")).drop("_claim", "_chunk")


def best_quote(claim: Column, content: Column) -> Column:
    """The first of the chunk's sentences that shares most words with the claim, else its first 200 characters."""
    parts = F.filter(F.transform(F.split(content, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    words = T.grounding_words(claim)
    scored = F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(words, T.grounding_words(s))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.when((F.size(words) == 0) | (F.size(parts) == 0), F.trim(F.substring(content, 1, 200))).otherwise(F.array_max(scored)["s"])


def verify_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each (sentence, cited source) of (answer_id, query_id, answer); sources are (query_id, source_index, content…)."""
    short = F.lit(False)
    for mark in INSUFFICIENT_MARKS:
        short = short | F.lower("answer").contains(mark)
    rows = answers.filter(~short).select("answer_id", "query_id", F.posexplode(T.sentences("answer")).alias("claim_no", "sentence"))
    rows = rows.select("*", T.strip_citations(F.col("sentence")).alias("claim"), F.explode_outer(T.source_indices(F.col("sentence"))).alias("source_index"))
    joined = rows.join(sources, ["query_id", "source_index"], "left")
    scored = with_grounding(joined.withColumn("_content", F.coalesce("content", F.lit(""))), "claim", "_content")
    hit = F.col("content").isNotNull()
    return scored.withColumn("grounding_score", F.when(hit, F.col("grounding_score"))).withColumn("is_grounded", F.coalesce(hit & (F.col("grounding_score") >= GROUNDED), F.lit(False))).withColumn("phantom", F.col("source_index").isNotNull() & ~hit).drop("_content")


def verify_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Faithfulness and status of each answer."""
    claims = verify_claims(answers, sources).groupBy("answer_id", "claim_no").agg(F.max("is_grounded").alias("grounded"), F.max(F.col("source_index").isNull() | F.col("phantom")).alias("unattributed"))
    sums = claims.groupBy("answer_id").agg(F.count("*").alias("total_claims"), F.sum(F.col("grounded").cast("long")).alias("grounded_claims"), F.sum(F.col("unattributed").cast("long")).alias("unattributed_claims"))
    rows = answers.select("answer_id", "answer").join(sums, "answer_id", "left").fillna(0, ["total_claims", "grounded_claims", "unattributed_claims"])
    score = F.when(F.col("total_claims") > 0, F.round(F.col("grounded_claims") / F.nullif("total_claims", F.lit(0)), 4)).otherwise(F.lit(1.0))
    short = F.lower("answer").contains(INSUFFICIENT_MARKS[0]) | F.lower("answer").contains(INSUFFICIENT_MARKS[1])
    status = F.when(short, "insufficient_context").when(F.col("faithfulness_score") >= VERIFIED, "verified").when(F.col("faithfulness_score") >= PARTIAL, "partially_grounded").otherwise("unverified")
    return rows.withColumn("faithfulness_score", score).withColumn("grounding_status", status).drop("answer")
