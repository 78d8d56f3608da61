"""Queries: models, sketches and the audit of what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import geo
from calibra.functions.bins import epoch, floor_to
from calibra.models.continuous import ContinuousParams
from calibra.operators import calibration, fold, pooling, presence, scoring, series
from calibra.plans.registry import query
from calibra.plans.tables import FLAVOR, NOW, health, obs, read

#: Streams whose signal is how many observations there are.
COUNTS = tuple(s for s, flavor in FLAVOR.items() if flavor == "count")


@query()
def continuous_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = obs(spark, sf_dir).where(F.col("stream_id").isin(*(s for s in FLAVOR if s not in COUNTS))).withColumn("value", F.log1p("value"))
    return scoring.score_points(points, ContinuousParams(obs_scale=1.0, level_var=1e-4), "event_id")


@query()
def count_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).where(F.col("stream_id").isin(*COUNTS))
    return scoring.score_counts(fold.native_windows(o, 21600, NOW - 28 * 86400, NOW), 21600)


@query()
def tree_pool_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = geo.quad_cell(F.col("user_id") % 90 + 0.5, F.col("event_id") % 360 - 180.0, 2)
    o = read(spark, sf_dir, "events").where(F.col("event_type").isin(*COUNTS)).select(F.col("event_type").alias("stream_id"), cell.alias("cell"), epoch("ts").alias("ts"))
    return pooling.score_pooled(fold.native_windows(o, 86400, NOW - 28 * 86400, NOW), 86400)


@query()
def presence_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health(spark, sf_dir)
    return scoring.score_presence(presence.learnable(presence.expected_slots(h, 3600, NOW - 28 * 86400, NOW), presence.common_mode(h)))


@query()
def model_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the count and point models' own quantiles."""
    rows = continuous_model_q(spark, sf_dir).unionByName(count_model_q(spark, sf_dir))
    return calibration.verdicts(calibration.pit_stats(rows, NOW).withColumn("status", F.lit("nursery")))


@query()
def tdigest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.digests(obs(spark, sf_dir), ["stream_id"])


@query()
def injected_swarm_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours until s crosses the threshold after extra events are added to each cell."""
    o = obs(spark, sf_dir).where(F.col("stream_id").isin(*COUNTS)).select("stream_id", "cell", "ts")
    start = NOW - 5 * 86400
    extra = o.select("stream_id", "cell").distinct().select("stream_id", "cell", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + 6 * 3600).cast("long"), F.lit(1200).cast("long"))).alias("ts"))
    rows = scoring.score_counts(fold.native_windows(o.unionByName(extra), 3600, NOW - 14 * 86400, NOW), 3600)
    p = F.least(F.greatest(1 - F.col("q_detect"), F.lit(1e-300)), F.lit(1.0))
    s = series.cusum(rows, -F.ln(p), 2.0)
    return s.where((F.col("s") >= 4) & (F.col("bin_start") >= floor_to(F.lit(start).cast("long"), 3600))).groupBy("stream_id", "cell").agg(((F.min("bin_start") + 3600 - start) / 3600).alias("delay_hours"))
