"""Queries: the live path run over all events as a stream that ends (trigger availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import geo
from calibra.functions.bins import epoch
from calibra.operators import fold, pooling
from calibra.operators.shared import shared_folder, written
from calibra.plans.models import COUNTS
from calibra.plans.registry import query
from calibra.plans.tables import FLAVOR, NOW, THROTTLE_SQL, read, with_tables
from calibra.streaming import live, seeded

STATES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of observations that arrive up to ten minutes after their time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = epoch("ts")
    return e.select(F.col("event_type").alias("stream_id"), F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string")).alias("cell"), ts.alias("ts"), "value", (ts + F.pmod(F.col("event_id") * 37, F.lit(600))).alias("first_seen"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; on one machine a temporary one will do."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream that ends, through a Parquet sink in the shared folder."""
    spark = stream.sparkSession
    folder = _folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATES)  # timers and initial states need this one
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(with_tables("SELECT stream_id, cell, ts FROM obs GROUP BY ALL"))
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(live.once(stream_of_events(spark, sf_dir))).select("stream_id", "cell", "ts")


@query(with_tables("SELECT stream_id, cell, win_start, count(*) AS n FROM (SELECT stream_id, cell, CAST((ts + event_id * 37 % 600) // 3600 * 3600 AS BIGINT) AS win_start FROM obs) WHERE win_start + 3600 <= (SELECT max(ts + event_id * 37 % 600) - 60 FROM obs) GROUP BY 1, 2, 3"))
def stream_arrival_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(live.arrival_windows(stream_of_events(spark, sf_dir), 3600))


@query()
def stream_point_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stream_of_events(spark, sf_dir).where(F.col("stream_id").isin(*(s for s in FLAVOR if s not in COUNTS)))
    return run(live.score_points(points))


@query()
def stream_count_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(live.score_counts(stream_of_events(spark, sf_dir).where(F.col("stream_id").isin(*COUNTS)), 21600))


@query(THROTTLE_SQL.replace("{every}", "3600").replace("{delta}", "40"))
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(live.throttle(stream_of_events(spark, sf_dir), 3600, 40.0))


@query(with_tables(f", d AS (SELECT stream_id, cell, ts AS bin_start, 1 - exp(-avg(value) / 50e0) AS q FROM obs GROUP BY ALL), g AS (SELECT *, CASE WHEN bin_start - lag(bin_start) OVER w > 86400 THEN 1 ELSE 0 END AS gap, -ln(least(greatest(2 * least(q, 1 - q), 1e-300), 1e0)) - 2 AS x FROM d WINDOW w AS (PARTITION BY stream_id, cell ORDER BY bin_start)), r AS (SELECT *, sum(gap) OVER (PARTITION BY stream_id, cell ORDER BY bin_start ROWS UNBOUNDED PRECEDING) AS run FROM g), p AS (SELECT *, sum(x) OVER (PARTITION BY stream_id, cell, run ORDER BY bin_start ROWS UNBOUNDED PRECEDING) AS p FROM r) SELECT stream_id, cell, bin_start, round(p - least(0e0, min(p) OVER (PARTITION BY stream_id, cell, run ORDER BY bin_start ROWS UNBOUNDED PRECEDING)), 6) + 0e0 AS s FROM p"))
def stream_running_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live evidence of every series; of values of one second their mean is scored."""
    mean = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("stream_id"), F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string")).alias("cell"), epoch("ts").alias("bin_start")).agg((1 - F.exp(-F.avg("value") / 50.0)).alias("q"))
    folder = _folder(spark)
    mean.write.parquet(f"{folder}/scores")
    stream = spark.readStream.schema(mean.schema).parquet(f"{folder}/scores")
    return run(live.running_evidence(stream)).select("stream_id", "cell", "bin_start", (F.round("s", 6) + 0.0).alias("s"))


REGISTERED, QUARTER, CUT = NOW - 20 * 86400, 21600, NOW - 10 * 86400
_ARRIVED = "CAST(ts + event_id * 37 % 600 AS BIGINT)"
_IN = "stream_id IN ('click', 'view', 'signup')"


@query(with_tables(
    f", a AS (SELECT stream_id, cell, {_ARRIVED} AS seen FROM obs WHERE {_IN}), c AS (SELECT s.stream_id, 'NATION_' || CAST(i AS VARCHAR) AS cell FROM (SELECT DISTINCT stream_id FROM a) s, range(0, 30) t(i)), "
    f"w AS (SELECT CAST(unnest(range({REGISTERED} // {QUARTER} * {QUARTER}, (SELECT max(seen) FROM a) - 60 - {QUARTER} + 1, {QUARTER})) AS BIGINT) AS bin_start) "
    f"SELECT stream_id, cell, bin_start, bin_start = {REGISTERED} // {QUARTER} * {QUARTER} AS blank FROM c, w"))  # fmt: skip
def stream_registered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows scored of cells that are registered, five of which never report; blank: by a model that knew nothing yet."""
    streams = spark.createDataFrame([(s,) for s in COUNTS], "stream_id string")
    cells = streams.crossJoin(spark.range(30).select(F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("cell")))
    events = stream_of_events(spark, sf_dir).where(F.col("stream_id").isin(*COUNTS))
    scored = run(seeded.seeded_counts(events, seeded.registered(cells, REGISTERED, QUARTER), QUARTER))
    return scored.select("stream_id", "cell", "bin_start", (F.col("q_value") == 0.5).alias("blank"))


@query(with_tables(
    f", d AS (SELECT stream_id, cell, ts AS bin_start, 1 - exp(-avg(value) / 50e0) AS q FROM obs WHERE ts >= {CUT} - 86400 GROUP BY ALL), "
    "g AS (SELECT *, CASE WHEN bin_start - lag(bin_start) OVER w > 86400 THEN 1 ELSE 0 END AS gap, -ln(least(greatest(2 * least(q, 1 - q), 1e-300), 1e0)) - 2 AS x FROM d WINDOW w AS (PARTITION BY stream_id, cell ORDER BY bin_start)), "
    "r AS (SELECT *, sum(gap) OVER (PARTITION BY stream_id, cell ORDER BY bin_start ROWS UNBOUNDED PRECEDING) AS run FROM g), p AS (SELECT *, sum(x) OVER (PARTITION BY stream_id, cell, run ORDER BY bin_start ROWS UNBOUNDED PRECEDING) AS p FROM r), "
    f"s AS (SELECT stream_id, cell, bin_start, round(p - least(0e0, min(p) OVER (PARTITION BY stream_id, cell, run ORDER BY bin_start ROWS UNBOUNDED PRECEDING)), 6) + 0e0 AS s FROM p) SELECT * FROM s WHERE bin_start >= {CUT}"))  # fmt: skip
def stream_restored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of rows after a stop: the sums begin with those of the archive's last day."""
    scores = written(read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stream_id"), F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string")).alias("cell"), epoch("ts").alias("bin_start")).agg((1 - F.exp(-F.avg("value") / 50.0)).alias("q")))
    folder = f"{_folder(spark)}/scores"
    scores.where(F.col("bin_start") >= CUT).write.parquet(folder)
    stream = spark.readStream.schema(scores.schema).parquet(folder)
    return run(seeded.restored_evidence(stream, seeded.restored_sums(scores, CUT))).select("stream_id", "cell", "bin_start", (F.round("s", 6) + 0.0).alias("s"))


def _quad() -> Column:
    """A cell of the sphere made from user_id."""
    return geo.quad_cell(F.col("user_id") % 90 + 0.5, F.col("user_id") * 7 % 360 - 180.0, 2)


@query(with_tables(
    f", c AS (SELECT DISTINCT stream_id, user_id % 90 AS lat, user_id * 7 % 360 AS lon FROM obs WHERE {_IN}), w AS (SELECT CAST(unnest(range({REGISTERED} // 86400 * 86400, (SELECT max({_ARRIVED}) FROM obs WHERE {_IN}) - 60 - 86400 + 1, 86400)) AS BIGINT) AS bin_start), "
    "q AS (SELECT DISTINCT stream_id, lat // 45 AS y, lon // 90 AS x FROM c) SELECT stream_id, bin_start, count(*) AS cells, count(*) AS same FROM q, w GROUP BY ALL"))  # fmt: skip
def stream_pooled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each window closed by a stream of pooled regions, and how many have the quantile of the batch pool."""
    arrived = epoch("ts") + F.pmod(F.col("event_id") * 37, F.lit(600))
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin(*COUNTS)).select(F.col("event_type").alias("stream_id"), _quad().alias("cell"), arrived.alias("ts"))
    begin, until = REGISTERED - REGISTERED % 86400, NOW + 5 * 86400
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where(F.col("event_type").isin(*COUNTS))
    stream = events.select(F.col("event_type").alias("stream_id"), _quad().alias("cell"), arrived.alias("first_seen"))
    seeds = written(rows.select("stream_id", "cell").distinct().withColumn("waits", F.lit(begin).cast("long")))
    live_rows = run(seeded.pooled_counts(stream, seeds, 86400))
    batch = pooling.score_pooled(fold.native_windows(rows, 86400, begin, until), 86400).select("stream_id", "cell", "bin_start", F.col("q_value").alias("_q"), F.col("q_detect").alias("_d"))
    near = (F.abs(F.col("q_value") - F.col("_q")) < 1e-9) & (F.abs(F.col("q_detect") - F.col("_d")) < 1e-9)
    return live_rows.join(batch, ["stream_id", "cell", "bin_start"], "left").groupBy("stream_id", "bin_start").agg(F.count("*").alias("cells"), F.count_if(near).alias("same"))


@query(with_tables(
    f", m AS (SELECT stream_id, {_ARRIVED} AS received, value FROM obs), now AS (SELECT max(received) AS now FROM m), "
    "g AS (SELECT *, CASE WHEN received - lag(received) OVER w > 600 THEN 1 ELSE 0 END AS gap FROM m WINDOW w AS (PARTITION BY stream_id ORDER BY received, value)), "
    "i AS (SELECT *, sum(gap) OVER (PARTITION BY stream_id ORDER BY received, value ROWS UNBOUNDED PRECEDING) AS link FROM g), "
    "l AS (SELECT stream_id, link, min(received) AS opened, max(received) + 601 AS ends FROM i GROUP BY ALL), k AS (SELECT *, CASE WHEN ends <= now THEN ends END AS closed, least(ends, now) AS upto FROM l, now), "
    "beats AS (SELECT stream_id, link, opened, unnest(range(opened + 3600, upto + 1, 3600)) AS beat FROM k) "
    "SELECT stream_id, opened AS ts, 'connected' AS event, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean FROM k UNION ALL SELECT stream_id, closed, 'reconnect', 0, NULL FROM k WHERE closed IS NOT NULL "
    "UNION ALL SELECT b.stream_id, b.beat, 'ok', count(i.received), NULL FROM beats b LEFT JOIN i ON i.stream_id = b.stream_id AND i.link = b.link AND i.received >= b.beat - 3600 AND i.received < b.beat GROUP BY b.stream_id, b.beat "
    "UNION ALL SELECT stream_id, win, 'window', count(*), round(avg(value), 9) FROM (SELECT i.*, received // 900 * 900 AS win, opened, upto FROM i JOIN k USING (stream_id, link)) WHERE win >= opened AND win + 900 <= upto GROUP BY stream_id, link, win"))  # fmt: skip
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats, breaks and whole windows of the message links, from their landed messages."""
    messages = stream_of_events(spark, sf_dir).select("stream_id", F.col("first_seen").alias("received"), "value")
    return run(seeded.supervised_links(messages, 3600, 600, 900)).withColumn("mean", F.round("mean", 9))
