"""Queries: calibration audit, presence, alert policies, views, digest, usage, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import pit
from calibra.functions.bins import floor_to
from calibra.operators import alerts, calibration, digest, joins, presence, probes, push, sweep, usage, views
from calibra.plans.detail import evidence_sql, made_evidence
from calibra.plans.registry import query
from calibra.plans.tables import MODALITY, MODALITY_SQL, NOW, health, lookup, obs, read, regions, surprise, with_tables

_STATS = """, v AS (SELECT *, max(model_version) OVER (PARTITION BY stream_id) AS newest FROM surprise WHERE q_value IS NOT NULL AND bin_start >= 1705363200), r AS (SELECT *, CAST(greatest(least(floor(q_value * 10), 9), 0) AS INTEGER) AS d FROM v WHERE model_version = newest),
s AS (SELECT stream_id, count(*) AS n, (max(bin_start) - min(bin_start)) / 86400e0 AS span_days, count(*) FILTER (q_value < 0.01e0) AS lo, count(*) FILTER (q_value > 0.99e0) AS hi, """ + " + ".join(f"abs(count(*) FILTER (d = {i}) / CAST(count(*) AS DOUBLE) - 0.1e0)" for i in range(10)) + " AS tv2 FROM r GROUP BY stream_id)"  # fmt: skip


@query(with_tables(_STATS + " SELECT stream_id, n, round(span_days, 6) AS span_days, round(tv2 / 2, 9) AS tv, round(lo / (n * 0.01e0), 9) AS lo_ratio, round(hi / (n * 0.01e0), 9) AS hi_ratio FROM s", "surprise"))
def pit_tv_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calibration.pit_stats(surprise(spark, sf_dir), NOW)
    return s.select("stream_id", "n", F.round("span_days", 6).alias("span_days"), *[F.round(c, 9).alias(c) for c in ("tv", "lo_ratio", "hi_ratio")])


_OVER = "((lo / (n * 0.01e0) > {t} AND (lo - n * 0.01e0) / sqrt(n * 0.01e0) > 3) OR (hi / (n * 0.01e0) > {t} AND (hi - n * 0.01e0) / sqrt(n * 0.01e0) > 3))"
_GOOD = "(n >= 200 AND span_days >= 3 AND tv2 / 2 <= 0.05e0 AND NOT " + _OVER.format(t=2) + " AND NOT (lo / (n * 0.01e0) < 0.5e0 AND (lo - n * 0.01e0) / sqrt(n * 0.01e0) < -3) AND NOT (hi / (n * 0.01e0) < 0.5e0 AND (hi - n * 0.01e0) / sqrt(n * 0.01e0) < -3))"
_BAD = "(n >= 200 AND span_days >= 3 AND (tv2 / 2 > 0.10e0 OR " + _OVER.format(t=3) + "))"


@query(with_tables(_STATS + f" SELECT stream_id, CASE WHEN stream_id IN ('click', 'error') THEN CASE WHEN {_GOOD} THEN 'active' ELSE 'nursery' END ELSE CASE WHEN {_BAD} THEN 'quarantined' ELSE 'active' END END AS next_status, CASE WHEN n < 200 OR span_days < 3 THEN 'too few' WHEN {_GOOD} THEN 'pass' WHEN {_BAD} THEN 'fail' ELSE 'watch' END AS verdict FROM s", "surprise"))
def nursery_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calibration.pit_stats(surprise(spark, sf_dir), NOW).withColumn("status", F.when(F.col("stream_id").isin("click", "error"), "nursery").otherwise("active"))
    return calibration.verdicts(s).select("stream_id", "next_status", "verdict")


@query(with_tables(", r AS (SELECT stream_id, q_value, row_number() OVER (PARTITION BY stream_id ORDER BY q_value) AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM surprise WHERE q_value IS NOT NULL) SELECT stream_id, count(*) AS n, round(max(greatest(i / CAST(n AS DOUBLE) - q_value, q_value - (i - 1) / CAST(n AS DOUBLE))), 9) AS ks, round(avg(CASE WHEN q_value > 0.99e0 THEN 1e0 ELSE 0e0 END), 9) AS p99 FROM r GROUP BY stream_id", "surprise"))
def ks_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.ks_distance(surprise(spark, sf_dir), ["stream_id"]).select("stream_id", "n", F.round("ks", 9).alias("ks"), F.round("p99", 9).alias("p99"))


@query(with_tables(", w AS (SELECT ts - ts % 3600 AS win_start, count(DISTINCT component) AS polled, count(DISTINCT CASE WHEN event IN ('ok', 'not_modified') THEN component END) AS present FROM health GROUP BY 1) SELECT win_start, polled, present FROM w WHERE polled >= 3 AND (polled - present) / CAST(polled AS DOUBLE) >= 0.5e0", "health"))
def common_mode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.common_mode(health(spark, sf_dir)).select("win_start", "polled", "present")


@query(with_tables(f", g AS (SELECT component, unnest(generate_series({NOW} - 604800, {NOW} - 3600, 3600)) AS slot FROM (SELECT DISTINCT component FROM health)), r AS (SELECT component, ts - ts % 3600 AS slot, bool_or(event IN ('ok', 'not_modified')) AS reported FROM health WHERE ts >= {NOW} - 604800 AND ts < {NOW} GROUP BY ALL) SELECT component, slot, reported, reported IS NOT NULL AS polled FROM g LEFT JOIN r USING (component, slot)", "health"))
def expected_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.expected_slots(health(spark, sf_dir), 3600, NOW - 604800, NOW).select("component", "slot", "reported", "polled")


@query(with_tables(f", g AS (SELECT ts - ts % 3600 AS slot, component, bool_or(event IN ('ok', 'not_modified')) AS reported FROM health WHERE ts >= {NOW} - 604800 AND ts < {NOW} GROUP BY ALL), w AS (SELECT ts - ts % 3600 AS win_start FROM health GROUP BY 1 HAVING count(DISTINCT component) >= 3 AND (count(DISTINCT component) - count(DISTINCT CASE WHEN event IN ('ok', 'not_modified') THEN component END)) / CAST(count(DISTINCT component) AS DOUBLE) >= 0.5e0) SELECT component, slot, reported, CAST((slot // 3600) % 24 AS INTEGER) AS hour FROM g WHERE slot NOT IN (SELECT win_start FROM w)", "health"))
def learnable_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health(spark, sf_dir)
    return presence.learnable(presence.expected_slots(h, 3600, NOW - 604800, NOW), presence.common_mode(h)).select("component", "slot", "reported", "hour")


_EVID = f", d AS (SELECT *, coalesce(q_detect, q_value) AS q FROM surprise WHERE q_value IS NOT NULL AND bin_start >= {NOW} - 86400), p AS (SELECT *, sum(-ln(least(greatest(2 * least(q, 1 - q), 1e-300), 1e0)) - 0.5e0) OVER w AS p FROM d WINDOW w AS (PARTITION BY stream_id, cell ORDER BY bin_start ROWS UNBOUNDED PRECEDING)), e AS (SELECT *, p - least(0e0, min(p) OVER (PARTITION BY stream_id, cell ORDER BY bin_start ROWS UNBOUNDED PRECEDING)) AS s FROM p), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY stream_id, cell ORDER BY bin_start DESC) = 1), k AS (SELECT stream_id, cell, bin_start, q, CAST(NULL AS DOUBLE) AS presence_q, greatest(q, 1 - q) AS extremity, s FROM l WHERE s >= 0.5e0 AND bin_start >= {NOW} - 10800), z AS (SELECT stream_id, cell, max(bin_start) AS bin_start, arg_max(presence_q, bin_start) AS presence_q, count(*) FILTER (presence_q >= 0.9e0) AS n FROM surprise WHERE q_value IS NULL AND bin_start >= {NOW} - 86400 GROUP BY ALL), c AS (SELECT * FROM k UNION ALL SELECT stream_id, cell, bin_start, NULL, presence_q, presence_q, CAST('inf' AS DOUBLE) FROM z WHERE presence_q >= 0.9e0 AND n >= 2)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a lower threshold and drift than the defaults, so that the test events have candidates
    return alerts.candidates(surprise(spark, sf_dir).where(F.col("bin_start") <= NOW + 86400), NOW, F.lit("both"), 0.5, 0.5)


@query(with_tables(_EVID + " SELECT stream_id, cell, bin_start, round(q, 9) AS q, round(extremity, 9) AS extremity, round(s, 6) AS s FROM c", "surprise"))
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("stream_id", "cell", "bin_start", F.round("q", 9).alias("q"), F.round("extremity", 9).alias("extremity"), F.round("s", 6).alias("s"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).join(regions(spark, sf_dir), "cell").withColumn("modality", lookup("stream_id", MODALITY))


@query(with_tables(_EVID + f", m AS (SELECT c.*, region, {MODALITY_SQL} AS modality FROM c JOIN regions USING (cell)), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY region, stream_id ORDER BY s DESC, cell) <= 3) SELECT region, count(DISTINCT modality) AS modalities, count(*) AS members, round(least(1e0, avg(extremity) * count(DISTINCT modality) / 2), 9) AS severity FROM t WHERE region <> 'ASIA' GROUP BY region HAVING count(DISTINCT modality) >= 2", "surprise", "regions"))
def corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = spark.createDataFrame([("ASIA", "open"), ("EUROPE", "resolved")], "region string, status string")
    return alerts.corroborated(_members(spark, sf_dir), open_).withColumn("severity", F.round("severity", 9))


@query(with_tables(f", m AS (SELECT stream_id, cell, region, max(value) / 30 AS s FROM obs JOIN regions USING (cell) WHERE ts >= {NOW} - 259200 GROUP BY ALL), n AS (SELECT stream_id, region, count(DISTINCT cell) AS sensors FROM m WHERE s >= -ln(0.1e0) - 0.5e0 GROUP BY ALL HAVING count(DISTINCT cell) >= 2) SELECT stream_id, region, sensors, count(*) OVER (PARTITION BY stream_id) AS regions FROM n QUALIFY count(*) OVER (PARTITION BY stream_id) <= 5 AND NOT (stream_id = 'click' AND region = 'ASIA')", "regions"))
def single_source_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = obs(spark, sf_dir).where(F.col("ts") >= NOW - 259200).join(regions(spark, sf_dir), "cell").groupBy("stream_id", "cell", "region").agg((F.max("value") / 30).alias("s")).withColumn("q", F.lit(0.5))
    old = spark.createDataFrame([(NOW - 60, "ASIA", ["click"]), (NOW - 999999, "EUROPE", ["click"])], "opened_at long, region string, streams array<string>")
    return alerts.single_source(m, old, NOW, min_sensors=2, q_tail=0.1, drift=0.5).select("stream_id", "region", "sensors", "regions")


@query(with_tables(f", f AS (SELECT stream_id, region, cell, ts, event_id FROM obs JOIN regions USING (cell) WHERE ts >= {NOW} - 86400 AND ts + event_id * 37 % 600 >= {NOW} - 86400) SELECT stream_id, region, ts FROM f QUALIFY row_number() OVER (PARTITION BY stream_id, region ORDER BY ts, cell) = 1", "regions"))
def every_event_first_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibra.plans.tables import first_seen

    seen = first_seen(obs(spark, sf_dir)).join(regions(spark, sf_dir), "cell")
    none = spark.createDataFrame([], "opened_at long, region string, streams array<string>")
    return alerts.every_event(seen, none, NOW, 86400).select("stream_id", "region", "ts")


_TWENTY = evidence_sql("true", 0.01, "CAST(event_id // 20 AS BIGINT)")


def _alert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-evidence scores of alerts of twenty events each."""
    return sweep.scores(made_evidence(spark, sf_dir, 0.01).withColumn("alert_id", F.floor(F.col("event_id") / 20).cast("long")).drop("event_id"))


@query(with_tables(_TWENTY + " SELECT alert_id, round(score, 6) AS score, modalities, confirmed, stage FROM scored", "surprise"))
def alert_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alert_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(with_tables(", c AS (SELECT stream_id, region, max(value) / 50 AS score FROM obs JOIN regions USING (cell) GROUP BY ALL) SELECT stream_id, region, round(score, 6) AS score, count(*) OVER (PARTITION BY stream_id) AS regions, 0.6e0 AS severity FROM c WHERE score >= 6 QUALIFY count(*) OVER (PARTITION BY stream_id) <= 5 AND region <> 'ASIA'", "regions"))
def provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = obs(spark, sf_dir).join(regions(spark, sf_dir), "cell").groupBy("stream_id", "region").agg((F.max("value") / 50).alias("score"))
    taken = spark.createDataFrame([("ASIA",)], "region string")
    none = spark.createDataFrame([], "opened_at long, region string, streams array<string>")
    return alerts.provisional(s, taken, none, NOW).select("stream_id", "region", F.round("score", 6).alias("score"), "regions", "severity")


#: Own evidence of an alert: errors of its nation; new readings: all others of its region that have a quantile.
_OF_REGION = "(SELECT s.*, al.cell AS alert FROM surprise s JOIN regions r ON r.cell = s.cell JOIN regions al ON al.region = r.region WHERE al.region <> 'ASIA' AND CASE WHEN s.stream_id = 'error' THEN al.cell = s.cell ELSE s.event_id % 41 <> 0 AND coalesce(s.q_value, s.presence_q) IS NOT NULL END)"


@query(with_tables(evidence_sql("true", 0.01, "alert", _OF_REGION) + " SELECT alert_id, stage AS new_stage, CASE WHEN stage = 2 THEN 0.95e0 ELSE 0.8e0 END AS severity, n_added FROM scored JOIN (SELECT alert_id, count(DISTINCT stream_id || cell) AS n_added FROM ev WHERE stream_id <> 'error' GROUP BY 1) USING (alert_id) WHERE stage > 0", "surprise", "regions"))
def region_escalation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a nation absorbs the readings of its whole region; those of a region are resolved."""
    r, ev = regions(spark, sf_dir), made_evidence(spark, sf_dir, 0.01).drop("alert_id", "event_id")
    own, new = ev.where("stream_id = 'error'").join(r.select("cell"), "cell").withColumn("alert_id", F.col("cell")), ev.where("stream_id <> 'error'").join(r, "cell")
    open_ = r.select(F.col("cell").alias("alert_id"), "region", F.lit(NOW - 60).alias("opened_at"), F.when(F.col("region") == "ASIA", "resolved").otherwise("open").alias("status"), F.lit(0.5).alias("severity"), F.lit(0).alias("stage"))
    return sweep.escalations(open_, own, new, NOW).select("alert_id", "new_stage", "severity", F.size("added").cast("long").alias("n_added"))


_LEVEL = "(CASE WHEN value >= 50 THEN 1 ELSE 0 END + CASE WHEN value >= 100 THEN 1 ELSE 0 END + CASE WHEN value >= 200 THEN 1 ELSE 0 END)"


@query(with_tables(f", l AS (SELECT stream_id, cell, {_LEVEL} AS level FROM obs) SELECT stream_id, CAST(CASE WHEN count(DISTINCT CASE WHEN level >= 3 THEN cell END) >= 12 THEN 3 WHEN count(DISTINCT CASE WHEN level >= 2 THEN cell END) >= 12 THEN 2 WHEN count(DISTINCT CASE WHEN level >= 1 THEN cell END) >= 12 THEN 1 ELSE 0 END AS INTEGER) AS harm_level, CAST(max(level) AS INTEGER) AS highest FROM l GROUP BY stream_id"))
def harm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    return alerts.confirmed_harm(o, ["stream_id"], alerts.harm_level(F.col("value"), [50.0, 100.0, 200.0]), 12, 3)


@query(with_tables(_TWENTY + " SELECT round(greatest(CASE WHEN count(*) >= 14 THEN min(score) ELSE 8e0 END, 8e0), 6) AS threshold FROM (SELECT score FROM scored ORDER BY score DESC LIMIT 14)", "surprise"))
def budget_kth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return push.budget_threshold(_alert_scores(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"))


@query(with_tables(_TWENTY + " SELECT alert_id FROM scored WHERE score >= 8 AND NOT (alert_id % 2 = 0 AND stage <= 1) ORDER BY round(score, 6) DESC, alert_id LIMIT 3", "surprise"))
def push_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _alert_scores(spark, sf_dir).withColumn("score", F.round("score", 6))
    sent = s.where("alert_id % 2 = 0").select("alert_id", F.lit(1).alias("stage"), F.when(F.col("alert_id") == 0, NOW - 60).otherwise(NOW - 999999).alias("ts"))
    return push.to_push(s, sent, 8.0, NOW).select("alert_id")


@query(with_tables(f", r AS (SELECT *, coalesce(greatest(q_value, 1 - q_value), presence_q) AS x FROM surprise WHERE bin_start >= {NOW} - 86400) SELECT cell, round(max(x), 9) AS extremity, list_sort(list(DISTINCT stream_id)) AS streams, count(DISTINCT stream_id) AS n_streams FROM r GROUP BY cell", "surprise"))
def surprise_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pit.row_extremity(F.col("q_value"), F.col("presence_q"), F.lit("both"))
    return views.surprise_by_cell(surprise(spark, sf_dir), x, NOW - 86400).withColumn("extremity", F.round("extremity", 9))


@query(with_tables(f"SELECT stream_id, round(max(presence_q), 9) AS presence_q, max(bin_start) AS last FROM surprise WHERE q_value IS NULL AND presence_q >= 0.5e0 AND bin_start >= {NOW} - 604800 GROUP BY stream_id", "surprise"))
def silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.silent_sources(surprise(spark, sf_dir), NOW - 604800, 0.5).withColumn("presence_q", F.round("presence_q", 9))


@query(with_tables(f", s AS (SELECT component, count(*) FILTER (event IN ('ok', 'not_modified')) AS n_ok, count(*) FILTER (event NOT IN ('ok', 'not_modified')) AS n_errors, max(CASE WHEN event IN ('ok', 'not_modified') THEN ts END) AS last_ok FROM health WHERE ts >= {NOW} - 604800 GROUP BY component) SELECT component, n_ok, n_errors, last_ok, CASE WHEN n_ok + n_errors = 0 THEN 'waiting' WHEN last_ok IS NULL THEN 'error' WHEN {NOW} - last_ok > 3 * 3600 + 600 THEN 'stale' ELSE 'ok' END AS state FROM s", "health"))
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.source_state(views.health_summary(health(spark, sf_dir), NOW - 604800), 3600, NOW).select("component", "n_ok", "n_errors", "last_ok", "state")


@query(with_tables(", p AS (SELECT stream_id, cell, count(*) AS n, max(value) AS vmax FROM obs GROUP BY ALL) SELECT stream_id, CAST(sum(n) AS BIGINT) AS total, (list(cell ORDER BY n DESC, cell))[1] AS busiest, max(n) AS busiest_n, max(vmax) AS largest, (list(cell ORDER BY vmax DESC, cell))[1] AS largest_cell FROM p GROUP BY stream_id"))
def busiest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.busiest(obs(spark, sf_dir))


@query(with_tables("SELECT stream_id, ts - ts % 21600 AS bin_start, count(*) * 3600 / 21600e0 AS per_hour FROM obs GROUP BY ALL"))
def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.per_hour(obs(spark, sf_dir), 21600)


@query(with_tables(", l AS (SELECT stream_id, cell, arg_max(value, ts * 1000000 + event_id) AS value FROM obs GROUP BY ALL) SELECT stream_id, round(median(value), 9) AS median, count(*) AS cells FROM l GROUP BY stream_id"))
def latest_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_median(obs(spark, sf_dir)).withColumn("median", F.round("median", 9))


@query(with_tables("SELECT stream_id, cell, (list(value ORDER BY value))[CAST(count(*) // 2 + 1 AS INTEGER)] AS typical, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) >= 3"))
def upper_median_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.typical_level(obs(spark, sf_dir), ["stream_id", "cell"], "value")


@query(with_tables(", x AS (SELECT *, greatest(q_value, 1 - q_value) AS x FROM surprise WHERE q_value IS NOT NULL), r AS (SELECT stream_id, count(*) FILTER (q_value >= 0.99e0 OR q_value <= 0.01e0) AS rare FROM x GROUP BY 1) SELECT x.stream_id, x.cell, x.bin_start, round(x.q_value, 9) AS q_value, r.rare FROM x JOIN r USING (stream_id) QUALIFY row_number() OVER (PARTITION BY x.stream_id ORDER BY x.x DESC, x.event_id) = 1", "surprise"))
def peak_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.peak(surprise(spark, sf_dir), pit.tail_extremity(F.col("q_value"), F.lit("both"))).withColumn("q_value", F.round("q_value", 9))


@query("SELECT o_orderkey AS alert_id FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) WHERE o_custkey % 3 <> 0")
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_orderdate").alias("opened_at"), "o_custkey")
    return views.alert_feed(a, 100, F.col("o_custkey") % 3 != 0).select("alert_id")


@query("SELECT c_custkey AS alert_id, coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'none') AS label FROM customer")
def label_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alert_id"), F.lit("none").alias("label"))
    given = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("alert_id"), F.col("o_orderkey").alias("ts"), F.col("o_orderpriority").alias("label"))
    return views.with_label(a, given)


_DEV = ", d AS (SELECT *, 2 * least(q_value, 1 - q_value) AS p, CASE WHEN q_value > 0.5e0 THEN 'high' ELSE 'low' END AS direction FROM surprise WHERE q_value IS NOT NULL), f AS (SELECT stream_id, cell, direction, count(*) AS n, min(bin_start) AS first, max(bin_start) AS last, min(p) AS p FROM d WHERE p <= 0.02e0 GROUP BY ALL)"


def _deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.deviations(surprise(spark, sf_dir), 0, NOW * 2, pit.tail_p(F.col("q_value"), F.lit("both")), 0.02)


@query(with_tables(_DEV + " SELECT stream_id, cell, direction, n, first, last, round(p, 9) AS p FROM f", "surprise"))
def weekly_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deviations(spark, sf_dir).select("stream_id", "cell", "direction", "n", "first", "last", F.round("p", 9).alias("p"))


@query(with_tables(_DEV + " SELECT stream_id, cell, direction, row_number() OVER (PARTITION BY stream_id ORDER BY p, n DESC, cell, direction) AS rank, greatest(count(*) OVER (PARTITION BY stream_id) - 5, 0) AS rest FROM f QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY p, n DESC, cell, direction) <= 5", "surprise"))
def top_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = digest.top_places(_deviations(spark, sf_dir), 5)
    return t.select("stream_id", "cell", "direction", F.col("rank").cast("long").alias("rank"), F.col("rest").cast("long").alias("rest"))


@query(with_tables(_DEV + ", r AS (SELECT stream_id, count(*) AS readings FROM surprise WHERE q_value IS NOT NULL GROUP BY 1), g AS (SELECT stream_id, count(*) AS places FROM f GROUP BY 1) SELECT stream_id, readings, places, round(places / (readings * 0.02e0), 9) AS excess FROM r JOIN g USING (stream_id)", "surprise"))
def streams_by_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = surprise(spark, sf_dir).where("q_value is not null").groupBy("stream_id").agg(F.count("*").alias("readings"))
    return digest.by_excess(_deviations(spark, sf_dir), readings, 0.02).withColumn("excess", F.round("excess", 9))


@query(with_tables(", f AS (SELECT DISTINCT stream_id FROM surprise WHERE q_value > 0.9999e0) SELECT DISTINCT stream_id FROM obs WHERE stream_id NOT IN (SELECT stream_id FROM f)", "surprise"))
def quiet_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.quiet(obs(spark, sf_dir).select("stream_id").distinct(), surprise(spark, sf_dir).where("q_value > 0.9999"))


@query(with_tables("SELECT stream_id, count(*) AS n, count(DISTINCT cell) AS cells FROM surprise WHERE q_value IS NULL AND presence_q >= 0.5e0 GROUP BY 1", "surprise"))
def silences_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.silences(surprise(spark, sf_dir), 0.5)


@query(with_tables("SELECT component, event, count(*) AS n FROM health WHERE event <> 'ok' GROUP BY ALL ORDER BY n DESC, component, event LIMIT 10", "health"))
def health_troubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.troubles(health(spark, sf_dir), 10)


@query("SELECT o_orderkey AS alert_id, o_orderstatus AS stage FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) <= 30")
def last_30_per_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_orderdate").alias("opened_at"), F.col("o_orderstatus").alias("stage"))
    return digest.last_by_stage(a).select("alert_id", "stage")


@query("SELECT o_orderstatus AS feedback, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_orderstatus").alias("feedback"))
    return digest.feedback(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("alert_id")), a)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(with_tables("SELECT stream_id AS component, CAST(ts // 86400 AS BIGINT) AS day, CAST(sum(event_id) AS BIGINT) AS bytes_in, CAST(sum(user_id) AS BIGINT) AS bytes_out, count(*) AS requests FROM obs GROUP BY ALL"))
def traffic_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(obs(spark, sf_dir).select(F.col("stream_id").alias("component"), "ts", F.col("event_id").alias("bytes_in"), F.col("user_id").alias("bytes_out"), F.lit(1).cast("long").alias("requests")))


@query("SELECT s_nationkey AS nation, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 9) AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("quantity")).join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    return usage.shares(rows, "quantity", "nation").withColumn("share", F.round("share", 9))


@query(with_tables(", c AS (SELECT stream_id, ts, event_id * 3 % 1000 AS c, lag(event_id * 3 % 1000) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS b FROM obs), d AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN c >= b THEN c - b ELSE c END AS d FROM c) SELECT stream_id, round(CAST(sum(d) AS DOUBLE) / (greatest(max(ts) - min(ts), 3600) / 86400e0), 6) AS c_a_day FROM d GROUP BY stream_id"))
def usage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibra.operators.series import counter_deltas

    rows = obs(spark, sf_dir).withColumn("c", F.col("event_id") * 3 % 1000).withColumn("at", F.col("ts") * 10000000 + F.col("event_id"))
    d = counter_deltas(rows, ["c"], ["stream_id"], "at")
    span = F.greatest(F.max("ts") - F.min("ts"), F.lit(3600)) / 86400.0
    return d.groupBy("stream_id").agg(F.round(F.sum("d_c") / span, 6).alias("c_a_day"))


@query("WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT * FROM t ORDER BY n DESC, name LIMIT 5) SELECT * FROM k UNION ALL SELECT 'others', CAST(sum(n) AS BIGINT) FROM t WHERE name NOT IN (SELECT name FROM k)")
def top_and_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("name"), F.lit(1).cast("long").alias("n"))
    return usage.top_and_rest(rows, "n", "name", 5)


@query("SELECT DISTINCT o_orderpriority AS kind FROM orders WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 1000 = 1)")
def new_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    sent = o.where("o_orderkey % 1000 = 1").select(F.col("o_orderpriority").alias("kind"), F.lit(NOW).alias("ts"))
    return usage.new_warnings(o.select(F.col("o_orderpriority").alias("kind")).distinct(), sent, NOW)


_IP = "CAST(10 + c_custkey % 3 AS VARCHAR) || '.' || CAST(c_custkey % 7 AS VARCHAR) || '.' || CAST(c_custkey % 11 AS VARCHAR) || '.' || CAST(c_custkey % 200 AS VARCHAR)"
_IPN = "(10 + c_custkey % 3) * 16777216 + (c_custkey % 7) * 65536 + (c_custkey % 11) * 256 + c_custkey % 200"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat_ws(".", (c % 3 + 10).cast("string"), (c % 7).cast("string"), (c % 11).cast("string"), (c % 200).cast("string")).alias("ip"), (F.col("c_nationkey") % 4).cast("string").alias("cc"), "c_custkey")


@query(f"WITH t AS (SELECT {_IP} AS ip, min({_IPN}) AS n, min(CAST(c_nationkey % 4 AS VARCHAR)) AS cc FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey % 4) = 1), a AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cc, n // 256 ORDER BY n) <= 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cc, n // 65536 ORDER BY n) <= 2) SELECT ip, cc FROM b QUALIFY row_number() OVER (PARTITION BY cc ORDER BY n) <= 10")
def spread_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.spread(probes.only_one_country(_targets(spark, sf_dir)), 10).select("ip", "cc")


@query("WITH a AS (SELECT c_custkey AS id, c_nationkey AS cc, c_custkey % 13 AS asn FROM customer), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY cc, asn ORDER BY id) = 1) SELECT id, cc, asn FROM l QUALIFY row_number() OVER (PARTITION BY cc ORDER BY asn) <= 3")
def distinct_asn_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cc"), (F.col("c_custkey") % 13).alias("asn"))
    return probes.anchors(a, 3)


@query(f"SELECT {_IP} AS ip, c_custkey FROM customer WHERE NOT ({_IPN} BETWEEN 184549376 AND 184614911)")
def opted_out_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = spark.createDataFrame([(184549376, 184614911)], "low long, high long")
    return probes.without_networks(_targets(spark, sf_dir), nets).select("ip", "c_custkey")


@query(with_tables(", r AS (SELECT ts - ts % 86400 AS round_ts, cell AS cc, CASE WHEN value > 20 THEN value END AS rtt FROM obs), p AS (SELECT round_ts, cc, count(*) FILTER (rtt IS NULL) AS failed, count(*) AS probed FROM r GROUP BY ALL) SELECT * FROM p QUALIFY sum(failed) OVER (PARTITION BY round_ts) / CAST(sum(probed) OVER (PARTITION BY round_ts) AS DOUBLE) <= 0.5e0"))
def probe_round_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = obs(spark, sf_dir).select(floor_to(F.col("ts"), 86400).alias("round_ts"), F.col("cell").alias("cc"), F.when(F.col("value") > 20, F.col("value")).alias("rtt"))
    return probes.round_tally(r)


@query(with_tables("SELECT stream_id, cell, event_id FROM obs WHERE stream_id NOT IN ('view', 'error')"))
def status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([("click", "active", "i"), ("view", "nursery", "i"), ("error", "retired", "n"), ("signup", "active", "e"), ("purchase", "active", "e")], "stream_id string, status string, modality string")
    return joins.gated(obs(spark, sf_dir), s).select("stream_id", "cell", "event_id")
