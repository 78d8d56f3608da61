"""Observations, surprise rows and dimensions made from the test tables, in Spark and in SQL.

Stream = event type, cell = the nation that user_id falls on, region = the nation's region. The
quantile of an event is that of its value under an exponential distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.bins import epoch, floor_to

#: 2024-01-30 00:00 UTC: "now" of all queries.
NOW = 1706572800
MODALITY = {"click": "informational", "view": "informational", "purchase": "economic", "signup": "economic", "error": "infrastructural"}
FLAVOR = {"click": "count", "view": "count", "purchase": "continuous", "signup": "count", "error": "continuous"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(column: str, mapping: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, cell, ts, value, event_id, user_id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("stream_id"), F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string")).alias("cell"), epoch("ts").alias("ts"), "value", "event_id", "user_id")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell -> region (25 rows)."""
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("cell"), F.col("r_name").alias("region"))


def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, cell, bin_start, q_value, presence_q, q_detect, model_version, event_id: one row an event."""
    q = 1 - F.exp(-F.col("value") / 50.0)
    silent = F.pmod("event_id", F.lit(11)) == 0
    return obs(spark, sf_dir).select(
        "stream_id", "cell", F.col("ts").alias("bin_start"), F.when(~silent, q).alias("q_value"), F.when(silent, q).otherwise(1.0).alias("presence_q"),
        F.when(~silent & (F.pmod("event_id", F.lit(7)) == 0), q * 0.99).alias("q_detect"), F.pmod("user_id", F.lit(2)).cast("int").alias("model_version"), "event_id",
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component, ts, event, detail: outcomes of polls made from the events."""
    n = F.pmod("event_id", F.lit(10))
    return obs(spark, sf_dir).select(F.col("stream_id").alias("component"), "ts", F.when(n < 6, "ok").when(n < 7, "not_modified").when(n < 9, "http_error").otherwise("timeout").alias("event"), F.col("event_id").cast("string").alias("detail"))


def first_seen(rows: DataFrame) -> DataFrame:
    """Arrival of an observation: up to ten minutes after its time."""
    return rows.withColumn("first_seen", F.col("ts") + F.pmod(F.col("event_id") * 37, F.lit(600)))


def hourly(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin_start", floor_to(F.col("ts"), 3600))


_OBS = "obs AS (SELECT event_type AS stream_id, 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS cell, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id, user_id FROM events)"
_SURPRISE = (
    "surprise AS (SELECT stream_id, cell, ts AS bin_start, CASE WHEN event_id % 11 <> 0 THEN 1 - exp(-value / 50e0) END AS q_value, CASE WHEN event_id % 11 = 0 THEN 1 - exp(-value / 50e0) ELSE 1e0 END AS presence_q, "
    "CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN (1 - exp(-value / 50e0)) * 0.99e0 END AS q_detect, CAST(user_id % 2 AS INTEGER) AS model_version, event_id FROM obs)"
)
_HEALTH = (
    "health AS (SELECT stream_id AS component, ts, CASE WHEN event_id % 10 < 6 THEN 'ok' WHEN event_id % 10 < 7 THEN 'not_modified' WHEN event_id % 10 < 9 THEN 'http_error' ELSE 'timeout' END AS event, CAST(event_id AS VARCHAR) AS detail FROM obs)"
)
_REGIONS = "regions AS (SELECT n_name AS cell, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
_MODALITY = "CASE stream_id WHEN 'click' THEN 'informational' WHEN 'view' THEN 'informational' WHEN 'purchase' THEN 'economic' WHEN 'signup' THEN 'economic' WHEN 'error' THEN 'infrastructural' END"
MODALITY_SQL = _MODALITY


def with_tables(sql: str, *names: str) -> str:
    """SQL after the definitions of the named tables (obs always first)."""
    known = {"surprise": _SURPRISE, "health": _HEALTH, "regions": _REGIONS}
    return "WITH " + ", ".join([_OBS, *[known[n] for n in names]]) + " " + sql


#: A fold over each series: what is passed on depends on what was passed on before.
THROTTLE_SQL = (
    "WITH RECURSIVE " + _OBS + ", r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, cell ORDER BY ts, value) AS i FROM obs WHERE value IS NOT NULL), "
    "f(stream_id, cell, i, ts, value, passed) AS (SELECT stream_id, cell, i, ts, value, true FROM r WHERE i = 1 UNION ALL SELECT stream_id, cell, i, CASE WHEN go THEN ts ELSE last END, CASE WHEN go THEN value ELSE was END, go FROM "
    "(SELECT r.*, f.ts AS last, f.value AS was, r.ts - f.ts >= {every} OR abs(r.value - f.value) >= {delta} AS go FROM f JOIN r ON r.stream_id = f.stream_id AND r.cell = f.cell AND r.i = f.i + 1)) SELECT stream_id, cell, ts, value FROM f WHERE passed"
)
