"""Queries: scoring run by run from stored states, and weights of pooled nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.models.continuous import ContinuousParams
from calibra.operators import archive, commits, pooling
from calibra.operators.shared import shared_folder, written
from calibra.plans.registry import query
from calibra.plans.tables import FLAVOR, NOW, obs, read, with_tables

SCALE, WIDTH, BETWEEN = 6, 19200, NOW - 8 * 86400
#: All streams of the events; one is retired, and so isn't scored.
SOURCES = {s: archive.Source(f, "retired" if s == "view" else "live", ContinuousParams(level_var=1e-4) if f == "continuous" else None) for s, f in FLAVOR.items()}
_BINS = (
    f"bins AS (SELECT stream_id, cell, CAST({SCALE} AS INTEGER) AS scale, CAST(ts // {WIDTH} * {WIDTH} AS BIGINT) AS bin_start, count(*) AS n FROM obs WHERE stream_id <> 'view' GROUP BY ALL), "
    f"closed AS (SELECT * FROM bins WHERE bin_start <= {NOW} - 1200 - {WIDTH})"
)


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of one scale of all observations."""
    start = F.col("ts") - F.pmod("ts", F.lit(WIDTH))
    return written(obs(spark, sf_dir).groupBy("stream_id", "cell", F.lit(SCALE).alias("scale"), start.alias("bin_start")).agg(F.count("*").alias("n"), F.avg("value").alias("vmean")))


def _nothing(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], archive.ROWS), spark.createDataFrame([], archive.STATES)


@query(with_tables(f", {_BINS} SELECT stream_id, cell, scale, bin_start, n AS n_obs, CASE WHEN bin_start <= {BETWEEN} - 1200 - {WIDTH} THEN 1 ELSE 2 END AS run, true AS same FROM closed"))
def archive_scores_in_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two runs, the second from the first one's states; same: bit by bit what one run over everything gives."""
    all_bins, (rows, states) = bins(spark, sf_dir), _nothing(spark)
    first = archive.score_closed_bins(all_bins, rows, states, SOURCES, BETWEEN)
    second = archive.score_closed_bins(all_bins, first.rows, first.states, SOURCES, NOW)
    whole = archive.score_closed_bins(all_bins, rows, states, SOURCES, NOW).rows.select(*archive.KEY, "bin_start", F.col("q_value").alias("_q"), F.col("q_detect").alias("_d"))
    both = first.rows.withColumn("run", F.lit(1)).unionByName(second.rows.withColumn("run", F.lit(2)))
    same = F.col("q_value").eqNullSafe(F.col("_q")) & F.col("q_detect").eqNullSafe(F.col("_d"))
    return both.join(whole, [*archive.KEY, "bin_start"], "left").select(*archive.KEY, "bin_start", "n_obs", "run", same.alias("same"))


@query(with_tables(f", {_BINS}, fresh AS (SELECT * FROM closed WHERE bin_start > {BETWEEN} - 1200 - {WIDTH}), old AS (SELECT DISTINCT stream_id, cell FROM closed WHERE bin_start <= {BETWEEN} - 1200 - {WIDTH}) "
    "SELECT stream_id, cell, scale, min(bin_start) AS first_bin, 0.5e0 AS first_q, count(*) AS n_new, max(CASE WHEN old.cell IS NULL THEN 0 ELSE 1 END) AS resets FROM fresh LEFT JOIN old USING (stream_id, cell) GROUP BY stream_id, cell, scale"))  # fmt: skip
def archive_scores_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over states that another version wrote: each such series starts cold behind its cursor and says so."""
    all_bins, (rows, states) = bins(spark, sf_dir), _nothing(spark)
    first = archive.score_closed_bins(all_bins, rows, states, SOURCES, BETWEEN)
    foreign = first.states.withColumn("state", F.concat(F.unhex(F.lit("6300")), F.expr("substring(state, 3)")))
    second = archive.score_closed_bins(all_bins, first.rows, foreign, SOURCES, NOW)
    found = second.rows.groupBy(*archive.KEY).agg(F.min("bin_start").alias("first_bin"), F.min_by("q_value", "bin_start").alias("first_q"), F.count("*").alias("n_new"))
    resets = second.resets.groupBy(*archive.KEY).agg(F.count("*").cast("int").alias("resets"))
    return found.join(resets, archive.KEY, "left").withColumn("resets", F.coalesce("resets", F.lit(0)))


def _pooled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up scores of the nodes of a tree with three levels, for each day: rows like those of pooling.node_scores."""
    digit = lambda k: F.floor(F.col("user_id") / 4**k) % 4
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), F.concat(F.lit("q"), *(digit(k).cast("string") for k in range(3))).alias("cell"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("win_start"), "value")
    rows = e.withColumn("node", F.explode(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda k: F.substring("cell", F.lit(1), k))))
    found = rows.groupBy("stream_id", "node", "win_start").agg((F.sum((F.col("value") * 100).cast("long")) / -10000.0).alias("score"), F.collect_set(F.substring("cell", F.length("node") + 1, F.lit(1))).alias("children"))
    leaf = F.length("node") == 4
    return found.select("stream_id", "node", "win_start", "score", leaf.alias("leaf"), F.when(leaf, 0).otherwise(4 - F.size("children")).alias("missing"), F.lit(-0.25).alias("empty_score"))


_LOG_SUM = "greatest({a}, {b}) + ln(1 + exp(least({a}, {b}) - greatest({a}, {b})))"
_UP = _LOG_SUM.format(a="(ln(0.1e0) + score)", b="(ln(0.9e0) + split + (4 - kids) * -0.25e0)")
_NODES = (
    "e AS (SELECT event_type AS stream_id, 'q' || CAST(user_id % 4 AS VARCHAR) || CAST(user_id // 4 % 4 AS VARCHAR) || CAST(user_id // 16 % 4 AS VARCHAR) AS cell, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS win_start, value FROM events), "
    "s AS (SELECT stream_id, cell[1:k] AS node, win_start, sum(CAST(trunc(value * 100) AS BIGINT)) / -10000e0 AS score FROM e, unnest([2, 3, 4]) AS u(k) GROUP BY ALL), "
    "z4 AS (SELECT *, score AS z FROM s WHERE length(node) = 4), "
    f"z3 AS (SELECT *, {_UP} AS z FROM (SELECT s.*, split, kids FROM s JOIN (SELECT stream_id, node[1:3] AS node, win_start, sum(z) AS split, count(*) AS kids FROM z4 GROUP BY ALL) USING (stream_id, node, win_start))), "
    f"z2 AS (SELECT *, {_UP} AS z FROM (SELECT s.*, split, kids FROM s JOIN (SELECT stream_id, node[1:2] AS node, win_start, sum(z) AS split, count(*) AS kids FROM z3 GROUP BY ALL) USING (stream_id, node, win_start))), "
    "p2 AS (SELECT *, exp(least(0e0, ln(0.1e0) + score - z)) AS block FROM z2), p3 AS (SELECT *, exp(least(0e0, ln(0.1e0) + score - z)) AS block FROM z3), "
    "r3 AS (SELECT p3.stream_id, p3.node, p3.win_start, 1 - p2.block AS reach, p3.block FROM p3 JOIN p2 ON p2.stream_id = p3.stream_id AND p2.node = p3.node[1:2] AND p2.win_start = p3.win_start) "
)


@query("WITH " + _NODES + ("SELECT stream_id, node, win_start, round(block, 9) AS weight FROM p2 UNION ALL SELECT stream_id, node, win_start, round(reach * block, 9) FROM r3 "
    "UNION ALL SELECT z4.stream_id, z4.node, z4.win_start, round(r3.reach * (1 - r3.block), 9) FROM z4 JOIN r3 ON r3.stream_id = z4.stream_id AND r3.node = z4.node[1:3] AND r3.win_start = z4.win_start"))  # fmt: skip
def tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the nodes of a tree from given evidence: up by log-sums, down by shares, joined on (parent, window)."""
    return pooling.tree_weights(_pooled_nodes(spark, sf_dir)).select("stream_id", "node", "win_start", F.round("weight", 9).alias("weight"))


def _store(spark: SparkSession) -> commits.Store:
    return commits.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


_VERSIONED = "stream_id string, cell string, bin_start long, value double, version long"


@query(with_tables(", r AS (SELECT stream_id, cell, CAST(ts // 3600 * 3600 AS BIGINT) AS bin_start, value, event_id AS version FROM obs) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY stream_id, cell, bin_start ORDER BY version DESC) = 1"))
def export_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row of each key after three exports, one of which died before its manifest and ran again."""
    rows = written(obs(spark, sf_dir).select("stream_id", "cell", (F.col("ts") - F.pmod("ts", F.lit(3600))).alias("bin_start"), "value", F.col("event_id").alias("version")))
    store = _store(spark)
    (high,) = rows.agg(F.max("version")).first()
    first = store.export({"bins": (rows.where(F.col("version") <= (high or 0) // 2), "version")})
    store.write_batch("bins", rows.where("version % 2 = 0"), first.number + 1)  # a run that died
    store.export({"bins": (rows, "version")})
    store.export({"bins": (rows, "version")})
    return store.current("bins", _VERSIONED, ["stream_id", "cell", "bin_start"], "version")


@query(with_tables(f", {_BINS} SELECT stream_id, cell, scale, bin_start, n AS n_obs, CAST(CASE WHEN bin_start <= {BETWEEN} - 1200 - {WIDTH} THEN 1 ELSE 2 END AS INTEGER) AS batch FROM closed"))
def committed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after two runs from a store, the first of which was committed twice."""
    all_bins, store = bins(spark, sf_dir), _store(spark)
    for now in (BETWEEN, BETWEEN, NOW):
        rows, states = store.rows("surprise", archive.ROWS).drop("_batch"), store.rows("model_state", archive.STATES).drop("_batch")
        done = archive.score_closed_bins(all_bins, rows, states, SOURCES, now)
        commits.commit_scores(store, done, archive.ROWS, archive.STATES, now)
        commits.commit_scores(store, done, archive.ROWS, archive.STATES, now)
    return store.rows("surprise", archive.ROWS).select(*archive.KEY, "bin_start", "n_obs", F.col("_batch").alias("batch"))


@query(with_tables("SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN obs ON obs.cell = 'NATION_' || CAST(n_nationkey AS VARCHAR) GROUP BY ALL"))
def snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension read through the view of its last snapshot, beside an incremental table."""
    store = _store(spark)
    rows = obs(spark, sf_dir).select("stream_id", "cell", F.col("ts").alias("bin_start"), "value", F.col("event_id").alias("version"))
    store.export({"readings": (rows, "version")}, {"nation_snapshot": read(spark, sf_dir, "nation").limit(0)})
    store.export({}, {"nation_snapshot": read(spark, sf_dir, "nation")})
    store.create_views()
    store.rows("readings", _VERSIONED).createOrReplaceTempView("readings")
    return spark.sql("SELECT n_nationkey, n_name, count(*) AS n FROM nation_snapshot JOIN readings ON cell = concat('NATION_', n_nationkey) GROUP BY n_nationkey, n_name")
