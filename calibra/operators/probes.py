"""Reachability targets and what a round of probes says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.sizes import small


def ip_number(ip: Column) -> Column:
    part = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    return part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)


def only_one_country(listed: DataFrame) -> DataFrame:
    """Addresses listed for exactly one country; others are a fallback for a continent."""
    return listed.groupBy("ip").agg(F.min("cc").alias("cc"), F.count_distinct("cc").alias("_n")).where("_n = 1").drop("_n")


def spread(targets: DataFrame, most: int) -> DataFrame:
    """In address order: one of each /24, two of each /16, so many of each country.

    Each rule only removes later addresses, so three ranks in turn do what one pass would."""
    n = ip_number(F.col("ip"))
    rows = targets.withColumn("_ip", n)
    for by, k in (([F.floor(F.col("_ip") / 256)], 1), ([F.floor(F.col("_ip") / 65536)], 2), ([], most)):
        w = Window.partitionBy("cc", *by).orderBy("_ip")
        rows = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")
    return rows.drop("_ip")


def anchors(listed: DataFrame, most: int) -> DataFrame:
    """The lowest id of each network of a country, of the first networks."""
    low = listed.withColumn("_i", F.row_number().over(Window.partitionBy("cc", "asn").orderBy("id"))).where("_i = 1").drop("_i")
    return low.withColumn("_i", F.row_number().over(Window.partitionBy("cc").orderBy("asn"))).where(F.col("_i") <= most).drop("_i")


def without_networks(targets: DataFrame, networks: DataFrame) -> DataFrame:
    """Targets outside all opted-out networks (low, high as numbers); the list is configuration."""
    n = small(networks)
    return targets.withColumn("_ip", ip_number(F.col("ip"))).join(n, (F.col("_ip") >= n.low) & (F.col("_ip") <= n.high), "left_anti").drop("_ip")


def round_tally(results: DataFrame) -> DataFrame:
    """Failed and probed targets of each country and round, unless more than half of the round failed, which is our fault."""
    per = results.groupBy("round_ts", "cc").agg(F.count_if(F.col("rtt").isNull()).alias("failed"), F.count("*").alias("probed"))
    w = Window.partitionBy("round_ts")
    return per.withColumn("_share", F.sum("failed").over(w) / F.sum("probed").over(w)).where("_share <= 0.5").drop("_share")


def mislocated(results: DataFrame, least_ms: Column) -> DataFrame:
    """Targets that answered sooner than light could."""
    return results.where(F.col("rtt") < least_ms).select("ip").distinct()
