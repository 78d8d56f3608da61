"""From surprise rows to alerts: candidates, the four policies, scores and harm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.pit import detection_q, surprisal, tail_extremity
from calibra.operators.series import cusum, quota

# Fixed values of the policies.
DRIFT, THRESHOLD, RECENT, LOOKBACK, SILENT_TAIL, PERSIST = 2.0, 4.0, 3 * 3600, 24 * 3600, 0.9, 2
MODALITIES, PER_STREAM, Q_TAIL, MOST_REGIONS, COOLDOWN, PROVISIONAL, ESCALATE = 2, 3, 1e-4, 5, 6 * 3600, 6.0, 6 * 3600
EXTREME, LEAST_LOG_P = 15.0, 1e-15


def evidence_rows(rows: DataFrame, now: int, tail: Column, drift: float = DRIFT) -> DataFrame:
    """Data rows of the lookback with their running evidence s."""
    data = rows.where((F.col("bin_start") >= now - LOOKBACK) & F.col("q_value").isNotNull())
    data = data.withColumn("q", detection_q(F.col("q_detect"), F.col("q_value"))).withColumn("tail", tail)
    return cusum(data, surprisal(F.col("q"), F.col("tail")), drift)


def candidates(rows: DataFrame, now: int, tail: Column, threshold: float = THRESHOLD, drift: float = DRIFT) -> DataFrame:
    """Series that stand out now: data series by s at their latest row, silent ones by persistence."""
    last = evidence_rows(rows, now, tail, drift).groupBy("stream_id", "cell").agg(F.max_by(F.struct("bin_start", "q", "s", "tail"), "bin_start").alias("r")).select("stream_id", "cell", "r.*")
    data = last.where((F.col("s") >= threshold) & (F.col("bin_start") >= now - RECENT)).select("stream_id", "cell", "bin_start", "q", F.lit(None).cast("double").alias("presence_q"), tail_extremity(F.col("q"), F.col("tail")).alias("extremity"), "s")
    quiet = rows.where((F.col("bin_start") >= now - LOOKBACK) & F.col("q_value").isNull())
    silent = quiet.groupBy("stream_id", "cell").agg(F.max("bin_start").alias("bin_start"), F.max_by("presence_q", "bin_start").alias("presence_q"), F.count_if(F.col("presence_q") >= SILENT_TAIL).alias("k"))
    silent = silent.where((F.col("presence_q") >= SILENT_TAIL) & (F.col("k") >= PERSIST)).select("stream_id", "cell", "bin_start", F.lit(None).cast("double").alias("q"), "presence_q", F.col("presence_q").alias("extremity"), F.lit(float("inf")).alias("s"))
    return data.unionByName(silent)


def severity(extremity: Column, modalities: Column) -> Column:
    return F.least(F.lit(1.0), F.avg(extremity) * modalities / MODALITIES)


def corroborated(members: DataFrame, open_alerts: DataFrame, least: int = MODALITIES, per: int = PER_STREAM) -> DataFrame:
    """Regions where independent kinds of measurement stand out together and no alert is open.

    members: stream_id, cell, region, modality, s, extremity."""
    kept = quota(members, "region", per)
    n = F.count_distinct("modality")
    found = kept.groupBy("region").agg(n.alias("modalities"), F.count("*").alias("members"), severity(F.col("extremity"), n).alias("severity")).where(F.col("modalities") >= least)
    return found.join(open_alerts.where("status = 'open'").select("region"), "region", "left_anti")


def single_source(members: DataFrame, alerts: DataFrame, now: int, min_sensors: int = 3, q_tail: float = Q_TAIL, most_regions: int = MOST_REGIONS, drift: float = DRIFT) -> DataFrame:
    """Regions where enough sensors of one stream agree; a stream that fires in too many regions at once is at fault itself."""
    import math

    strong = members.where((F.col("s") >= -math.log(q_tail) - drift) & F.col("q").isNotNull())
    n = strong.groupBy("stream_id", "region").agg(F.count_distinct("cell").alias("sensors")).where(F.col("sensors") >= min_sensors)
    spread = n.withColumn("regions", F.count("*").over(Window.partitionBy("stream_id"))).where(F.col("regions") <= most_regions)
    return _not_since(spread, alerts, now - COOLDOWN)


def _not_since(rows: DataFrame, alerts: DataFrame, since: int) -> DataFrame:
    """Rows whose region has no alert with their stream in its evidence since a time."""
    old = alerts.where(F.col("opened_at") >= since).select("region", F.explode("streams").alias("stream_id")).distinct()
    return rows.join(old, ["region", "stream_id"], "left_anti")


def every_event(seen: DataFrame, alerts: DataFrame, now: int, fresh: int, cooldown: int = 0) -> DataFrame:
    """The first fresh event of each stream and region that no alert covers yet."""
    new = seen.where((F.col("first_seen") >= now - fresh) & (F.col("ts") >= now - fresh))
    open_ = _not_since(new, alerts, now - cooldown) if cooldown else new
    return open_.withColumn("_i", F.row_number().over(Window.partitionBy("stream_id", "region").orderBy("ts", "cell"))).where("_i = 1").drop("_i")


def provisional(scored: DataFrame, corroborated_: DataFrame, alerts: DataFrame, now: int, least: float = PROVISIONAL, most_regions: int = MOST_REGIONS) -> DataFrame:
    """Single strong candidates (stream_id, region, score) that no other policy has taken, severity 0.6."""
    strong = scored.where(F.col("score") >= least).withColumn("regions", F.count("*").over(Window.partitionBy("stream_id"))).where(F.col("regions") <= most_regions)
    return _not_since(strong.join(corroborated_.select("region"), "region", "left_anti"), alerts, now - COOLDOWN).withColumn("severity", F.lit(0.6))


def harm_level(value: Column, thresholds: list[float], below: bool = False) -> Column:
    """How many thresholds a reading has reached."""
    reached = [(value <= t if below else value >= t).cast("int") for t in thresholds]
    return F.coalesce(sum(reached, F.lit(0)), F.lit(0))


def confirmed_harm(readings: DataFrame, by: list[str], level: Column, least_sensors: int = 2, levels: int = 4) -> DataFrame:
    """Highest level that enough different cells reach."""
    n = [F.count_distinct(F.when(level >= i, F.col("cell"))) for i in range(1, levels + 1)]
    best = F.lit(0)
    for i, c in enumerate(n, 1):
        best = F.when(c >= least_sensors, i).otherwise(best)
    return readings.groupBy(*by).agg(best.alias("harm_level"), F.max(level).alias("highest"))
