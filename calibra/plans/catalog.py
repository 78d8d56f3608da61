"""All named queries; importing the modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calibra.plans import archive, detail, feeds, folding, ground, models, payloads, policy, streams, windows
from calibra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "archive", "detail", "feeds", "flagship", "folding", "ground", "models", "payloads", "policy", "streams", "windows"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.candidates(spark, sf_dir)
