"""Audit of quantiles: are a stream's surprises uniform, and what follows for its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.pit import decile

# Fixed values of the audit.
TAIL, LEAST_N, LEAST_DAYS, TV_PASS, TV_QUARANTINE, Z, OVER, OVER_DRIFT, UNDER = 0.01, 200, 3.0, 0.05, 0.10, 3.0, 2.0, 3.0, 0.5


def pit_stats(rows: DataFrame, now: int, days: int = 14) -> DataFrame:
    """n, span, total variation from uniform and tail ratios of each stream, newest model version only.

    One scan and one aggregation by (stream, version); the newest version is kept after it."""
    recent = rows.where((F.col("bin_start") >= now - days * 86400) & F.col("q_value").isNotNull())
    d = decile(F.col("q_value"))
    cells = [F.count_if(d == i).alias(f"d{i}") for i in range(10)]
    per = recent.groupBy("stream_id", "model_version").agg(
        F.count("*").alias("n"), ((F.max("bin_start") - F.min("bin_start")) / 86400.0).alias("span_days"), F.count_if(F.col("q_value") < TAIL).alias("lo"), F.count_if(F.col("q_value") > 1 - TAIL).alias("hi"), *cells
    )
    newest = per.withColumn("_new", F.max("model_version").over(Window.partitionBy("stream_id"))).where("model_version = _new").drop("_new")
    tv = sum((F.abs(F.col(f"d{i}") / F.col("n") - 0.1) for i in range(10)), F.lit(0.0)) / 2
    return newest.select("stream_id", "model_version", "n", "span_days", tv.alias("tv"), (F.col("lo") / (F.col("n") * TAIL)).alias("lo_ratio"), (F.col("hi") / (F.col("n") * TAIL)).alias("hi_ratio"), "lo", "hi")


def tail_z(k: Column, n: Column) -> Column:
    """How many deviations a tail count lies above what n uniform quantiles give."""
    return (k - n * TAIL) / F.sqrt(n * TAIL)


def verdicts(stats: DataFrame) -> DataFrame:
    """Next status of each stream (with its present status): nursery, active or quarantined."""
    enough = (F.col("n") >= LEAST_N) & (F.col("span_days") >= LEAST_DAYS)

    def heavy(times: float) -> Column:
        over = lambda k, r: (F.col(r) > times) & (tail_z(F.col(k), F.col("n")) > Z)
        return over("lo", "lo_ratio") | over("hi", "hi_ratio")

    light = lambda k, r: (F.col(r) < UNDER) & (tail_z(F.col(k), F.col("n")) < -Z)
    good = enough & (F.col("tv") <= TV_PASS) & ~heavy(OVER) & ~light("lo", "lo_ratio") & ~light("hi", "hi_ratio")
    bad = enough & ((F.col("tv") > TV_QUARANTINE) | heavy(OVER_DRIFT))
    next_ = F.when((F.col("status") == "nursery") & good, "active").when((F.col("status") == "active") & bad, "quarantined").when((F.col("status") == "quarantined") & good, "active").otherwise(F.col("status"))
    verdict = F.when(~enough, "too few").when(good, "pass").when(bad, "fail").otherwise("watch")
    return stats.withColumn("next_status", next_).withColumn("verdict", verdict)


def ks_distance(rows: DataFrame, by: list[str], q: str = "q_value") -> DataFrame:
    """Kolmogorov-Smirnov distance of each group's quantiles from uniform, and its tail rates."""
    w = Window.partitionBy(*by)
    ranked = rows.where(F.col(q).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(q))).withColumn("_n", F.count("*").over(w))
    gap = F.greatest(F.col("_i") / F.col("_n") - F.col(q), F.col(q) - (F.col("_i") - 1) / F.col("_n"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.max(gap).alias("ks"), F.avg((F.col(q) > 0.99).cast("double")).alias("p99"), F.avg((F.col(q) > 0.999).cast("double")).alias("p999"))
