"""Queries of the training-data operators, one a numbered operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibra.llm.bpe import bpe_encode
from calibra.llm.collocations import phrase_collocations
from calibra.llm.common import table
from calibra.llm.fertility import quality_rules
from calibra.llm.filter_audit import filter_audit
from calibra.llm.language import language_predictions
from calibra.llm.maxscore import exact_top_k
from calibra.llm.mixing import mix_plan
from calibra.llm.ngram_join import ngram_jaccard_classes
from calibra.llm.oracles import ORACLES
from calibra.llm.pii import pii_digest
from calibra.llm.pivot_dedup import near_duplicates
from calibra.llm.quality import quality_scores
from calibra.llm.secrets import secret_digest
from calibra.llm.toxicity import toxicity_scores


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"), k=4, p=85, q=100)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_embedding_near_dedup, op2_pii, op3_bpe_round_trip, op4_ngram_jaccard_join, op5_language_id, op6_toxicity, op7_mix_sources, op8_quality, op9_exact_top_k, op10_secret_scan, op11_filter_interaction_audit, op12_phrase_collocations, op13_quality_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
