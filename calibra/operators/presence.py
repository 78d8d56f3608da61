"""Silence: expected slots, our own deafness, and absence that many sources share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions.bins import floor_to, hour_of_day

# Outcomes that count as a report, and the common-mode rule.
PRESENT = ("ok", "not_modified")
WINDOW, LEAST_POLLED, ABSENT_SHARE = 3600, 3, 0.5


def expected_slots(health: DataFrame, cadence: int, since: int, until: int) -> DataFrame:
    """Cadence slots of each component since a cursor: polled (any row) and reported (a present one).

    A slot without any row is missing: the system was deaf, which says nothing of the source."""
    rows = health.where(F.col("ts").between(since, until - 1)).groupBy("component", floor_to(F.col("ts"), cadence).alias("slot")).agg(F.max(F.col("event").isin(*PRESENT)).alias("reported"))
    grid = health.select("component").distinct().withColumn("slot", F.explode(F.sequence(F.lit(floor_py(since, cadence)).cast("long"), F.lit(floor_py(until - 1, cadence)).cast("long"), F.lit(cadence).cast("long"))))
    return grid.join(rows, ["component", "slot"], "left").withColumn("polled", F.col("reported").isNotNull())


def floor_py(ts: int, width: int) -> int:
    return ts // width * width


def common_mode(health: DataFrame, window: int = WINDOW, least: int = LEAST_POLLED, share: float = ABSENT_SHARE) -> DataFrame:
    """Windows in which so large a share of the polled components was absent that the fault is ours."""
    w = floor_to(F.col("ts"), window).alias("win_start")
    n = health.groupBy(w).agg(F.count_distinct("component").alias("polled"), F.count_distinct(F.when(F.col("event").isin(*PRESENT), F.col("component"))).alias("present"))
    return n.where((F.col("polled") >= least) & ((F.col("polled") - F.col("present")) / F.col("polled") >= share))


def learnable(slots: DataFrame, common: DataFrame, window: int = WINDOW) -> DataFrame:
    """Polled slots outside common-mode windows, with their hour of day."""
    return slots.where("polled").withColumn("win_start", floor_to(F.col("slot"), window)).join(common.select("win_start"), "win_start", "left_anti").withColumn("hour", hour_of_day(F.col("slot"))).drop("win_start")
