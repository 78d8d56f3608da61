"""Which alerts are pushed, within a daily and a weekly budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Pushes a day, least score, extreme pushes a week.
PER_DAY, LEAST_SCORE, EXTREMES = 2, 8.0, 1


def budget_threshold(scores: DataFrame, per_day: int = PER_DAY, days: int = 7, least: float = LEAST_SCORE) -> DataFrame:
    """The score of the last alert that a week's budget would have covered, the least score at least."""
    k = per_day * days
    top = scores.orderBy(F.desc("score")).limit(k)
    return top.agg(F.greatest(F.when(F.count("*") >= k, F.min("score")).otherwise(least), F.lit(least)).alias("threshold"))


def to_push(alerts: DataFrame, pushed: DataFrame, threshold: float, now: int, per_day: int = PER_DAY) -> DataFrame:
    """Alerts over the threshold whose stage rose since their last push, the best first, within twice the daily budget.

    What is left of the budget is one number, so a rank does what a loop over the alerts would."""
    last = pushed.groupBy("alert_id").agg(F.max("stage").alias("pushed_stage"))
    used = pushed.where(F.col("ts") >= now - 86400).agg(F.count("*").alias("used"))
    fresh = alerts.where(F.col("score") >= threshold).join(last, "alert_id", "left").where(F.col("pushed_stage").isNull() | (F.col("stage") > F.col("pushed_stage")))
    ranked = fresh.orderBy(F.desc("score"), "alert_id").limit(2 * per_day).withColumn("_i", F.row_number().over(Window.orderBy(F.desc("score"), "alert_id")))
    return ranked.crossJoin(F.broadcast(used)).where(F.col("_i") <= 2 * per_day - F.col("used")).drop("_i", "used", "pushed_stage")
