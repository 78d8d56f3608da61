"""Folds by document id and bounded label samples, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod mod is rest; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def label_sample(labels: DataFrame, column: str, mod: int, rest: int, bound: int) -> DataFrame:
    """At most bound labelled ids (doc_id, label) outside the held-out fold, chosen by hash.

    An id with several labels takes the largest; null ids and labels are left out. The result
    has a proven size, so it may be broadcast."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(~in_fold(mod, rest))
    one = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
