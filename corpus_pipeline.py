"""Cleaning pipeline of a training corpus: each stage maps a documents table to the next.

toxicity -> n-gram Jaccard join -> secret scan -> mixing to target weights -> BPE round trip.
A stage's result is written as Parquet and read again as the next one's input, so a lost
executor costs at most one stage and no stage reads its predecessor's plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibra.llm.bpe import bpe_encode
from calibra.llm.common import shared_folder, table
from calibra.llm.mixing import with_mix_position
from calibra.llm.ngram_join import one_of_each_class
from calibra.llm.secrets import redact_secrets
from calibra.llm.toxicity import keep_clean

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the toxicity threshold.

    Null and empty texts stay; repeated rows are judged alike."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under Jaccard >= 0.8 of five-word shingles: the smallest doc_id.

    Documents without words stay; rows that share a doc_id are decided one by one."""
    return one_of_each_class(docs, k=5, p=4, q=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark. Null texts stay null."""
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_position, their place in the mix of sources to target weights.

    Order is a column, since readers of the written table don't keep the order of its rows."""
    return with_mix_position(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, mix_position) of each document."""
    return bpe_encode(docs, with_ids=False, keep=("mix_position",))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: Learned scores and byte-pair merges can't be said in SQL; tests/llm/test_pipeline.py checks run() by plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, with the tables between them in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
