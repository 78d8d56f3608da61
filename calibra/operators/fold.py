"""Folding observations into bins, and merging stored bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.bins import bin_start, floor_to, scale_for_age

KEYS = ["stream_id", "cell", "scale", "bin_start"]


def cascade_fold(obs: DataFrame, now: int, fine_window: int = 900) -> DataFrame:
    """Bins of the observations older than the fine window; a bin's scale follows from its age.

    n counts all rows, n_values those with a value; m2 is the sum of squared deviations. One
    shuffle with map-side partial moments."""
    aged = obs.where(F.lit(now) - F.col("ts") >= fine_window).withColumn("scale", scale_for_age(F.lit(now) - F.col("ts")))
    keyed = aged.withColumn("bin_start", bin_start(F.col("ts"), F.col("scale")))
    return keyed.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count("value").alias("n_values"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.avg("value").alias("vmean"),
        F.when(F.count("value") > 0, F.var_pop("value") * F.count("value")).alias("m2"),
    )


def with_sketch(obs: DataFrame, keys: list[str]) -> DataFrame:
    """A mergeable quantile sketch of the values of each key."""
    return obs.where("value is not null").groupBy(*keys).agg(F.expr("kll_sketch_agg_double(value)").alias("sketch"))


def merge_bins(*parts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One bin a key from bins of several runs, as if all values had come in one run."""
    bins = parts[0]
    for p in parts[1:]:
        bins = bins.unionByName(p)
    total, mass = F.sum("n_values"), F.sum(F.col("n_values") * F.col("vmean"))
    square = F.sum(F.col("m2") + F.col("n_values") * F.col("vmean") * F.col("vmean"))
    return bins.groupBy(*keys).agg(
        F.sum("n").alias("n"), total.alias("n_values"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), (mass / total).alias("vmean"),
        F.greatest(square - mass * mass / total, F.lit(0.0)).alias("m2"),
    )


def native_windows(obs: DataFrame, width: int, since: int, until: int) -> DataFrame:
    """Counts of all windows in [since, until) of each (stream, cell), quiet ones as zero."""
    counts = obs.where(F.col("ts").between(since, until - 1)).groupBy("stream_id", "cell", floor_to(F.col("ts"), width).alias("win_start")).agg(F.count("*").alias("n"))
    grid = obs.select("stream_id", "cell").distinct().withColumn("win_start", F.explode(F.sequence(F.lit(since).cast("long"), F.lit(until - width).cast("long"), F.lit(width).cast("long"))))
    return grid.join(counts, ["stream_id", "cell", "win_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def due_windows(obs: DataFrame, arrival: str, width: int, now: int, grace: int = 60, active: int = 30 * 86400) -> DataFrame:
    """Closed windows by arrival of every active cell, from its first report on, with zeros."""
    last = (now - grace - width) // width * width
    cells = obs.groupBy("stream_id", "cell").agg(F.min(floor_to(F.col(arrival), width)).alias("first"), F.max(arrival).alias("latest")).where((F.col("latest") >= now - active) & (F.col("first") <= last))
    due = cells.select("stream_id", "cell", F.explode(F.sequence("first", F.lit(last).cast("long"), F.lit(width).cast("long"))).alias("win_start"))
    counts = obs.groupBy("stream_id", "cell", floor_to(F.col(arrival), width).alias("win_start")).agg(F.count("*").alias("n"))
    return due.join(counts, ["stream_id", "cell", "win_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def counts_up_the_tree(obs: DataFrame, ancestors: str, width: int) -> DataFrame:
    """Counts of each node and window; an observation counts at its cell and all ancestors."""
    return obs.select("stream_id", F.explode(ancestors).alias("node"), floor_to(F.col("ts"), width).alias("win_start")).groupBy("stream_id", "node", "win_start").agg(F.count("*").alias("n"))


def busiest_and_world(rows: DataFrame, width: int, most: int, world: str = "WORLD") -> DataFrame:
    """(stream_id, cell, win_start, n): window counts of each stream as a whole and of its busiest cells, zeros included.

    Windows run from the first to the last of all rows."""
    counts = rows.groupBy("stream_id", "cell", (F.col("ts") - F.pmod("ts", F.lit(width))).alias("win_start")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("stream_id", "cell").agg(F.sum("n").alias("all"))
    busy = totals.withColumn("_i", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("all"), "cell"))).where(F.col("_i") <= most).select("stream_id", "cell")
    own = counts.join(busy, ["stream_id", "cell"], "left_semi").unionByName(counts.groupBy("stream_id", "win_start").agg(F.sum("n").alias("n")).withColumn("cell", F.lit(world)))
    span = counts.agg(F.min("win_start").alias("a"), F.max("win_start").alias("b"))
    series = own.select("stream_id", "cell").distinct().crossJoin(span).select("stream_id", "cell", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("win_start"))  # one row on the right
    return series.join(own, ["stream_id", "cell", "win_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
