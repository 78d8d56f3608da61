"""The human-readable record beside each observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sized(records: DataFrame, data: str = "data") -> DataFrame:
    """Records with the bytes of their JSON."""
    return records.withColumn("size", F.octet_length(F.to_json(data)).cast("long"))


def picked(fields: list[str], most: int = 400) -> Column:
    """Map of the named fields that are there, as trimmed and cut text."""
    entries = F.array(*[F.struct(F.lit(f).alias("k"), F.substring(F.trim(F.col(f).cast("string")), 1, most).alias("v")) for f in fields])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def top_distinct(records: DataFrame, by: list[str], link: Column, limit: int) -> DataFrame:
    """The best records of a key, one for each link: 8 x limit are ranked, then links made different, then limit kept.

    Fewer than limit can come back, as links are compared after the first cut."""
    order = [F.desc_nulls_last("rank"), F.desc("ts"), F.asc("event_id")]
    first = records.withColumn("_link", link).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= 8 * limit)
    once = first.withColumn("_j", F.row_number().over(Window.partitionBy(*by, "_link").orderBy("_i"))).where("_j = 1")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_i"))).where(F.col("_k") <= limit).drop("_i", "_j")


def map_quota(stories: DataFrame, by: list[str], weight: str, most: int = 5) -> DataFrame:
    """At most so many cells of a stream in a coarse region, by weight, then by name from the end."""
    return stories.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(weight), F.desc("cell")))).where(F.col("_i") <= most).drop("_i")
