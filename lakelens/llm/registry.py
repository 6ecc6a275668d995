"""Queries of the training-data operators, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from lakelens.llm import alignment, bpe, decontamination, licences, packing, quality_mil, quality_rules, sharding, simhash, suffix_dedup, toxicity, wavelet, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": licences.op1_licence_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_wavelet_token_ids": wavelet.op3_wavelet_token_ids,
    "op4_byte_shards": sharding.op4_byte_shards,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_quality_mil": quality_mil.op7_quality_mil,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_jacobi_whitening": whitening.op11_jacobi_whitening,
    "op12_vector_packing": packing.op12_vector_packing,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
    "pipeline": corpus_pipeline.run,
}

#: DuckDB SQL for those that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op4_byte_shards": sharding.OP4_SQL}
