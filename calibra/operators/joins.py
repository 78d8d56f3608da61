"""Joins by key, by time, by place, and by absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.sizes import small

KEY = ["stream_id", "cell", "ts"]


def unseen(new: DataFrame, seen: DataFrame, order: list[Column], key: list[str] = KEY) -> DataFrame:
    """Rows whose key was never seen, the first of each key in the batch's order."""
    first = new.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")
    return first.join(seen.select(*key).distinct(), key, "left_anti")


def unscored(raw: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows to replay after a stop, with the time they arrived."""
    return raw.where("not scored").join(seen, KEY, "inner")


def arrived_between(context: DataFrame, seen: DataFrame, start: int, end: int) -> DataFrame:
    """Records that arrived in [start, end)."""
    return context.join(seen.where((F.col("first_seen") >= start) & (F.col("first_seen") < end)), KEY, "inner")


def as_of_bin(asks: DataFrame, bins: DataFrame, period: int = 30 * 86400) -> DataFrame:
    """For each ask (ask_id, stream_id, cell, scale, at): the bin of that scale and start, else the latest at or before.

    Of bins with one start the least scale stands for it. Asks and bins are one table ordered
    by time, in which an ask takes the last bin seen, within a period of the series first and
    else from the last of the periods before, so a long series is many groups. Exact bins are
    found by their key. Asks without a bin keep nulls."""
    found = F.struct(F.col("scale").alias("bin_scale"), "bin_start", "n", "vmean")
    exact = bins.select("stream_id", "cell", "scale", F.col("bin_start").alias("at"), found.alias("exact"))
    held = bins.select("stream_id", "cell", F.col("bin_start").alias("at"), F.lit(0).alias("_asks"), (-F.col("scale")).alias("_order"), found.alias("bin"))
    both = held.unionByName(asks.withColumns({"_asks": F.lit(1), "_order": F.lit(0)}), allowMissingColumns=True).withColumn("_period", F.floor(F.col("at") / period))
    before = Window.partitionBy("stream_id", "cell", "_period").orderBy("at", "_asks", "_order").rowsBetween(Window.unboundedPreceding, 0)
    lasts = held.groupBy("stream_id", "cell", F.floor(F.col("at") / period).alias("_period")).agg(F.max_by("bin", F.struct("at", "_order")).alias("_last"))
    # the last bin of the periods before, for each period that is asked for
    periods = both.select("stream_id", "cell", "_period").distinct().join(lasts, ["stream_id", "cell", "_period"], "left")
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy("stream_id", "cell").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1))
    carries = periods.withColumn("_carry", carried).select("stream_id", "cell", "_period", "_carry")
    seen = both.withColumn("_seen", F.last("bin", ignorenulls=True).over(before)).where("_asks = 1")
    chosen = seen.join(carries, ["stream_id", "cell", "_period"]).join(exact, ["stream_id", "cell", "scale", "at"], "left")
    return chosen.withColumn("_bin", F.coalesce("exact", "_seen", "_carry")).select(*asks.columns, "_bin.*")


def in_interval(asks: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """Records with ts in [start, start + length) of each ask (ask_id, stream_id, cell, start, length).

    Both sides are bucketed by width, so that a long history is joined on (series, bucket) and
    not on the series alone."""
    a = asks.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width))))
    r = records.withColumn("_bucket", F.floor(F.col("ts") / width))
    return a.join(r, ["stream_id", "cell", "_bucket"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("start") + F.col("length"))).drop("_bucket")


def first_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The first configured box (ord, box, west, south, east, north) that holds each point; edges count.

    boxes is configuration and has a few rows."""
    inside = (F.col("lon") >= F.col("west")) & (F.col("lon") <= F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north"))
    hit = points.join(small(boxes), inside).groupBy("point_id").agg(F.min_by("box", "ord").alias("box"))
    return points.join(hit, "point_id")


def coverage(countries: DataFrame, targets: DataFrame, thin: int = 3) -> DataFrame:
    """Live targets of every country: unmonitored, thin or ok."""
    n = targets.groupBy("cc").agg(F.count("*").alias("n_targets"))
    joined = countries.join(n, "cc", "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)).cast("long"))
    return joined.withColumn("state", F.when(F.col("n_targets") == 0, "unmonitored").when(F.col("n_targets") < thin, "thin").otherwise("ok"))


def latest_verdict(calibration: DataFrame, order: str = "ts") -> DataFrame:
    """The last row of each stream in an order, with the stream's newest time."""
    return calibration.groupBy("stream_id").agg(F.max_by(F.struct("status", "verdict", "n"), order).alias("v"), F.max("ts").alias("ts")).select("stream_id", "ts", "v.*")


def nearest_home(places: DataFrame, homes: DataFrame, distance: Column, reach: str) -> DataFrame:
    """Places within their own reach of a home; homes are a handful of configured points."""
    return places.join(small(homes), distance <= F.col(reach), "left_semi")


def gated(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of known streams that are neither retired, quarantined nor in the nursery."""
    live = sources.where(~F.col("status").isin("retired", "nursery", "quarantined"))
    return rows.join(live.select("stream_id", "modality"), "stream_id")
