"""The corpus pipeline: quality, near-dedup, repeated passages, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of ``docs``; ``run`` writes each result as Parquet to the shared folder and reads it again as the next docs. A run
that was lost goes on after its last whole stage if it is given the same folder.

Defined results, in all stages: a null text counts as empty; texts of any length are handled whole; an empty table gives
an empty table of the same columns; extra columns pass through, whatever their names; each stage says the rest.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import bpe, decontamination, labelled, quality_mil, simhash, suffix_dedup
from lakelens.llm.common import keeps_columns, read_documents
from lakelens.session import prepare, scratch
from lakelens.sources.files import exists

#: The stages after the first are iterative or hash-based, so SQL gives no rows for run(); tests hold it to brute force.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return run_prepared


@prepared
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage-attention classifier scores 0.5 or more.

    Null and empty texts have the score of one passage of zeros; equal texts, and so repeated rows, stay or go together; a
    tie (0.5) stays. Without usable labels all stay.
    """
    return quality_mil.keep_good(docs, quality_mil.quality_model(docs, labelled.read_labels(spark, sf_dir)))


@prepared
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a similarity of 0.8 or more (sets of five-word shingles) hold together.

    It is that of least doc_id (a null one comes last), of equal ones that of least text hash, of repeated rows one. Texts
    without words, null ones among them, are one group.
    """
    return simhash.one_of_each(docs)


@keeps_columns
def without_repeats(docs: DataFrame) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs, carry=[c for c in docs.columns if c != "text"], characters=True)
    found = found.select(F.col("kept").cast("string").alias("text"), "rest").filter(F.expr("text rlike '[^ \\\\t-\\\\r]'"))
    of = {c: F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest").getField(c) for c in docs.columns}
    return found.select(*(value.alias(c) for c, value in of.items()))


@prepared
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that also start elsewhere; texts of which no word is left go.

    A character of which a part goes is dropped whole, no other is touched; n_chars, where there is one, is that of the
    text left. Null and empty texts have no word, so they go; repeated rows of 200 bytes or more remove each other.
    """
    return without_repeats(docs)


@prepared
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null, empty and short texts hold none and stay; repeated rows stay or go together; a similarity of exactly 0.8 goes.
    """
    return decontamination.without_contaminated(docs, decontamination.read_benchmark(spark, sf_dir))


@prepared
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of every text, with digests of the ids and of what they decode to.

    Null and empty texts have no ids; repeated rows give repeated rows.
    """
    return bpe.encode_with_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("decontaminate", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the table documents; stages that ``folder`` already holds whole are read and not run again."""
    prepare(spark)
    folder, docs = folder or scratch(spark, "pipeline"), read_documents(spark, sf_dir)
    for name, stage in STAGES:
        if not exists(spark, f"{folder}/{name}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
