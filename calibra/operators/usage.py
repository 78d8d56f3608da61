"""Traffic and resource accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.series import counter_deltas


def daily(rows: DataFrame) -> DataFrame:
    """Bytes and requests of each component and UTC day."""
    return rows.groupBy("component", F.floor(F.col("ts") / 86400).cast("long").alias("day")).agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.sum("requests").alias("requests"))


def shares(totals: DataFrame, column: str, by: str) -> DataFrame:
    """Each one's share of the whole, ranked."""
    whole = F.sum(column).over(Window.partitionBy())
    return totals.groupBy(by).agg(F.sum(column).alias(column)).select(by, column, (F.col(column) / whole).alias("share"))


def rates(samples: DataFrame, counters: list[str], by: list[str]) -> DataFrame:
    """Growth of restarting counters a day, over an hour's span at least."""
    d = counter_deltas(samples, counters, by)
    span = F.greatest(F.max("ts") - F.min("ts"), F.lit(3600)) / 86400.0
    return d.groupBy(*by).agg(*[(F.coalesce(F.sum(f"d_{c}"), F.lit(0)) / span).alias(f"{c}_a_day") for c in counters])


def top_and_rest(totals: DataFrame, column: str, by: str, n: int) -> DataFrame:
    """The n largest and one row for all others; ranks only the n largest."""
    per = totals.groupBy(by).agg(F.sum(column).alias(column))
    first = per.orderBy(F.desc(column), by).limit(n)
    rest = per.join(first.select(by), by, "left_anti").agg(F.sum(column).alias(column)).where(F.col(column).isNotNull()).select(F.lit("others").alias(by), column)
    return first.unionByName(rest)


def new_warnings(warnings: DataFrame, sent: DataFrame, now: int, quiet: int = 86400) -> DataFrame:
    """Warnings of a kind that none was sent of for a day."""
    return warnings.join(sent.where(F.col("ts") > now - quiet).select("kind").distinct(), "kind", "left_anti")
