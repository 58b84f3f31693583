"""The queries of this subpackage: name -> fn(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courtline.llm import (decontamination, embedding_dedup, exact_dedup, fill_in_middle, html_text, lm_scoring,
                           packing, phrases, quality, sharding, simhash, statements, suffix_dedup, toxicity)
from courtline.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of(table(spark, sf_dir, "documents"))


def op7_quality_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, QueryFn]:
    ops = (op1_tag_path_ratios, op2_suffix_dedup, op3_exact_dedup, op4_log_bilinear, op5_best_fit_packing,
           op6_label_propagation, op7_quality_voting, op8_simhash_near_dedup, op9_decontamination, op10_toxicity,
           op11_collocations, op12_fill_in_middle, op13_cap_filters)
    return {**{f.__name__: f for f in ops}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": statements.EXACT_DEDUP_SQL, "op11_collocations": statements.PHRASES_SQL,
            "op12_fill_in_middle": statements.FILL_IN_MIDDLE_SQL, "op13_cap_filters": statements.EMBEDDINGS_SQL}
