"""The weekly report as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A deviation's tail probability, places named for a stream, alerts for a stage.
DEVIATION, PLACES, ALERTS = 1e-3, 25, 30


def deviations(rows: DataFrame, start: int, end: int, p: Column, most: float = DEVIATION) -> DataFrame:
    """By stream, cell and direction: how often, from when to when, and the least probable row."""
    week = rows.where((F.col("bin_start") >= start) & (F.col("bin_start") < end) & F.col("q_value").isNotNull())
    out = week.withColumn("p", p).where(F.col("p") <= most).withColumn("direction", F.when(F.col("q_value") > 0.5, "high").otherwise("low"))
    return out.groupBy("stream_id", "cell", "direction").agg(F.count("*").alias("n"), F.min("bin_start").alias("first"), F.max("bin_start").alias("last"), F.min("p").alias("p"), F.min_by("q_value", F.struct("p", "bin_start", "event_id")).alias("worst_q"))


def top_places(found: DataFrame, most: int = PLACES) -> DataFrame:
    """The least probable places of each stream, and how many are left out."""
    w = Window.partitionBy("stream_id")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy("p", F.desc("n"), "cell", "direction"))).withColumn("rest", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most)


def by_excess(found: DataFrame, readings: DataFrame, most: float = DEVIATION) -> DataFrame:
    """Streams by deviating places over what chance gives for their readings."""
    n = found.groupBy("stream_id").agg(F.count("*").alias("places"))
    return readings.join(n, "stream_id").select("stream_id", "readings", "places", (F.col("places") / (F.col("readings") * most)).alias("excess"))


def quiet(readings: DataFrame, found: DataFrame) -> DataFrame:
    """Streams with readings and no deviation."""
    return readings.select("stream_id").join(found.select("stream_id").distinct(), "stream_id", "left_anti")


def silences(rows: DataFrame, least: float = 0.99) -> DataFrame:
    return rows.where(F.col("q_value").isNull() & (F.col("presence_q") >= least)).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("cells"))


def troubles(health: DataFrame, most: int = 40) -> DataFrame:
    """The commonest outcomes that aren't ok."""
    return health.where("event <> 'ok'").groupBy("component", "event").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component", "event").limit(most)


def last_by_stage(alerts: DataFrame, most: int = ALERTS) -> DataFrame:
    return alerts.withColumn("_i", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("opened_at"), F.desc("alert_id")))).where(F.col("_i") <= most).drop("_i")


def feedback(pushes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Different pushed alerts of each feedback value."""
    return pushes.join(alerts.select("alert_id", "feedback"), "alert_id").groupBy("feedback").agg(F.count_distinct("alert_id").alias("n"))
