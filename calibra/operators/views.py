"""Read queries behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surprise_by_cell(rows: DataFrame, extremity: Column, since: int) -> DataFrame:
    """Greatest extremity of each cell and the streams that have rows there."""
    return rows.where(F.col("bin_start") >= since).groupBy("cell").agg(F.max(extremity).alias("extremity"), F.array_sort(F.collect_set("stream_id")).alias("streams"), F.count_distinct("stream_id").alias("n_streams"))


def silent_sources(rows: DataFrame, since: int, threshold: float) -> DataFrame:
    return rows.where((F.col("bin_start") >= since) & F.col("q_value").isNull() & (F.col("presence_q") >= threshold)).groupBy("stream_id").agg(F.max("presence_q").alias("presence_q"), F.max("bin_start").alias("last"))


def health_summary(health: DataFrame, since: int) -> DataFrame:
    """Successes, errors, last success and last error of each component."""
    ok = F.col("event").isin("ok", "not_modified")
    return health.where(F.col("ts") >= since).groupBy("component").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_errors"), F.max(F.when(ok, F.col("ts"))).alias("last_ok"), F.max_by(F.when(~ok, F.col("event")), F.when(~ok, F.struct("ts", "detail"))).alias("last_error"))


def source_state(summary: DataFrame, cadence: int, now: int) -> DataFrame:
    """waiting, error, stale or ok."""
    state = F.when(F.col("n_ok") + F.col("n_errors") == 0, "waiting").when(F.col("last_ok").isNull(), "error").when(F.lit(now) - F.col("last_ok") > 3 * cadence + 600, "stale").otherwise("ok")
    return summary.withColumn("state", state)


def busiest(rows: DataFrame) -> DataFrame:
    """Total of each stream, its busiest cell (ties to the first name) and the largest value with its cell."""
    per = rows.groupBy("stream_id", "cell").agg(F.count("*").alias("n"), F.max("value").alias("vmax"))
    return per.groupBy("stream_id").agg(F.sum("n").alias("total"), F.min_by("cell", F.struct(-F.col("n"), F.col("cell"))).alias("busiest"), F.max("n").alias("busiest_n"), F.max("vmax").alias("largest"), F.min_by("cell", F.struct(-F.col("vmax"), F.col("cell"))).alias("largest_cell"))


def per_hour(rows: DataFrame, width: int) -> DataFrame:
    """Events an hour of each stream and window."""
    return rows.groupBy("stream_id", (F.col("ts") - F.pmod("ts", F.lit(width))).alias("bin_start")).agg((F.count("*") * 3600 / width).alias("per_hour"))


def latest_median(rows: DataFrame) -> DataFrame:
    """True median over cells of the latest value in each."""
    last = rows.groupBy("stream_id", "cell").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("stream_id").agg(F.median("value").alias("median"), F.count("*").alias("cells"))


def typical_level(rows: DataFrame, by: list[str], value: str, least: int = 3) -> DataFrame:
    """Upper median, where there are enough values: the value at half the count, from zero, in order."""
    w = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_n") >= least) & (F.col("_i") == F.floor(F.col("_n") / 2))).select(*by, F.col(value).alias("typical"), F.col("_n").alias("n"))


def peak(rows: DataFrame, extremity: Column) -> DataFrame:
    """The most extreme row of each stream and how many rows are rare."""
    return rows.where("q_value is not null").groupBy("stream_id").agg(F.max_by(F.struct("cell", "bin_start", "q_value"), F.struct(extremity, -F.col("event_id"))).alias("r"), F.count_if((F.col("q_value") >= 0.99) | (F.col("q_value") <= 0.01)).alias("rare")).select("stream_id", "r.*", "rare")


def activity(rows: DataFrame, since: int, per: int = 5) -> DataFrame:
    """Latest time and total of each stream and cell, within the map's quota by region."""
    own = rows.where(F.col("ts") >= since).groupBy("stream_id", "cell", "region").agg(F.count("*").alias("total"), F.max("ts").alias("latest"))
    return own.withColumn("_i", F.row_number().over(Window.partitionBy("stream_id", "region").orderBy(F.desc("total"), F.desc("cell")))).where(F.col("_i") <= per).drop("_i")


def alert_feed(alerts: DataFrame, limit: int, in_view: Column) -> DataFrame:
    """The newest alerts, then those of them in view: the limit comes first."""
    return alerts.orderBy(F.desc("opened_at"), F.desc("alert_id")).limit(limit).where(in_view)


def with_label(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Alerts with the last label given to each."""
    last = labels.groupBy("alert_id").agg(F.max_by("label", "ts").alias("new_label"))
    return alerts.join(last, "alert_id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
