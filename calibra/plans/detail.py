"""Queries: whole-evidence scores and sweeps, cell detail, places, and the choice among landed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.bins import floor_to
from calibra.operators import detail, landing, places, sweep
from calibra.plans.registry import query
from calibra.plans.tables import NOW, health, lookup, obs, read, regions, surprise, with_tables

_EVIDENCE = """, ev AS (SELECT {alert} AS alert_id, stream_id, cell, CASE stream_id WHEN 'click' THEN 'informational' WHEN 'view' THEN 'informational' WHEN 'purchase' THEN 'economic' WHEN 'signup' THEN 'economic' ELSE 'infrastructural' END AS modality,
  CASE stream_id WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'error' THEN NULL ELSE 'shop' END AS class, CASE WHEN event_id % 41 = 0 THEN NULL ELSE coalesce(q_value, presence_q) END AS q, CASE stream_id WHEN 'click' THEN 'upper' WHEN 'error' THEN 'lower' END AS tail,
  CASE WHEN event_id % 83 = 0 THEN 'source_alert' END AS kind, CASE WHEN stream_id = 'view' THEN 7e0 END AS push_score, stream_id = 'error' AS extreme, CASE WHEN stream_id = 'error' THEN 2 END AS min_sensors FROM {source} WHERE {where}),
 f AS (SELECT *, coalesce(kind = 'source_alert', false) AS issued, CASE WHEN class IS NULL THEN false ELSE max(coalesce(kind = 'source_alert', false)) OVER (PARTITION BY alert_id, class) END AS restated,
  greatest(least(greatest(CASE tail WHEN 'upper' THEN 1 - q WHEN 'lower' THEN q ELSE 2 * least(q, 1 - q) END, 1e-300), 1e0), 1e-15) AS p, CASE tail WHEN 'upper' THEN 1 - q WHEN 'lower' THEN q ELSE least(q, 1 - q) END AS one FROM ev),
 c AS (SELECT alert_id, stream_id, cell, max(CASE WHEN q IS NOT NULL AND NOT restated THEN -log10(p) END) AS e, sum(CASE WHEN issued AND q IS NULL THEN coalesce(push_score, 5e0) END) AS feed, max(issued) AS issued, max(coalesce(NOT issued AND extreme AND one <= {q_tail}, false)) AS strong, max(coalesce(min_sensors, 1)) AS need FROM f GROUP BY ALL),
 st AS (SELECT alert_id, stream_id, sum(e) AS e, sum(feed) AS feed, max(issued) AS issued, count(*) FILTER (strong) >= max(need) AND count(*) FILTER (strong) > 0 AS alone FROM c GROUP BY ALL),
 m AS (SELECT alert_id, count(DISTINCT modality) AS modalities FROM ev GROUP BY 1),
 t AS (SELECT alert_id, (coalesce(sum(e), 0) + coalesce(sum(feed), 0)) * CASE WHEN any_value(modalities) >= 2 THEN any_value(modalities) ELSE 1 END AS score, any_value(modalities) AS modalities, max(issued) OR max(alone) OR any_value(modalities) >= 2 AS confirmed FROM st JOIN m USING (alert_id) GROUP BY 1),
 scored AS (SELECT alert_id, score, CAST(modalities AS INTEGER) AS modalities, confirmed, CAST(CASE WHEN NOT confirmed THEN 0 WHEN score >= 15 THEN 2 ELSE 1 END AS INTEGER) AS stage FROM t)"""


def evidence_sql(where: str, q_tail: float, alert: str = "event_id % 300", source: str = "surprise") -> str:
    return _EVIDENCE.replace("{where}", where).replace("{q_tail}", str(q_tail)).replace("{alert}", alert).replace("{source}", source)


def made_evidence(spark: SparkSession, sf_dir: str, q_tail: float) -> DataFrame:
    """Evidence of 300 alerts made from the surprise rows."""
    from calibra.plans.tables import MODALITY

    i = F.col("event_id")
    return surprise(spark, sf_dir).select(
        (i % 300).alias("alert_id"), "stream_id", "cell", lookup("stream_id", MODALITY).alias("modality"), lookup("stream_id", {"click": "web", "view": "web", "purchase": "shop", "signup": "shop"}).alias("class"),
        F.when(i % 41 != 0, F.coalesce("q_value", "presence_q")).alias("q"), lookup("stream_id", {"click": "upper", "error": "lower"}).alias("tail"), F.when(i % 83 == 0, sweep.ISSUED).alias("kind"),
        F.when(F.col("stream_id") == "view", 7.0).alias("push_score"), (F.col("stream_id") == "error").alias("extreme"), F.lit(q_tail).alias("q_tail"), F.when(F.col("stream_id") == "error", 2).alias("min_sensors"), i.alias("event_id"),
    )


_MIXED = "CASE WHEN event_id % 300 < 150 OR stream_id = 'error' THEN event_id % 300 ELSE 300 + event_id % 150 END"


@query(with_tables(evidence_sql("true", 0.01, _MIXED) + " SELECT alert_id, round(score, 6) AS score, modalities, confirmed, stage FROM scored", "surprise"))
def whole_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of alerts with all streams, with errors alone, and with all but errors."""
    ev = made_evidence(spark, sf_dir, 0.01).withColumn("alert_id", F.expr(_MIXED)).drop("event_id")
    return sweep.scores(ev).withColumn("score", F.round("score", 6))


@query(with_tables(evidence_sql("event_id % 300 < 100 AND stream_id = 'error'", 0.01) + ", al AS (SELECT i AS alert_id FROM range(0, 120) x(i)) SELECT al.alert_id, round(coalesce(score, 0), 6) AS score, CAST(CASE WHEN stage IS NULL THEN -1 ELSE greatest(stage, CASE WHEN al.alert_id % 5 = 0 THEN 2 ELSE 0 END) END AS INTEGER) AS stage FROM al LEFT JOIN scored USING (alert_id)", "surprise"))
def effective_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = made_evidence(spark, sf_dir, 0.01).where("event_id % 300 < 100 and stream_id = 'error'").drop("event_id")
    alerts = spark.range(120).select(F.col("id").alias("alert_id"))
    return sweep.effective_stage(kept, alerts.where("alert_id % 5 = 0").withColumn("harm_stage", F.lit(2)), alerts).withColumn("score", F.round("score", 6))


@query(with_tables(evidence_sql("event_id % 300 < 100 AND event_id // 300 % 16 = 0", 0.01).replace(" AS stage FROM t)", " AS stage FROM t), before AS (SELECT alert_id, stage AS old, CASE WHEN alert_id % 7 = 0 THEN 'closed' ELSE 'open' END AS status FROM scored), have AS (SELECT alert_id, stream_id, cell FROM ev), young AS (SELECT * FROM before WHERE status = 'open' AND alert_id % 50 < 40 AND old < 2)") + """,
  extra AS (SELECT y.alert_id, e.stream_id, e.cell, count(*) AS n FROM young y JOIN (SELECT event_id % 20 AS region, stream_id, cell FROM surprise WHERE event_id % 9 = 0 AND event_id % 41 <> 0) e ON e.region = y.alert_id % 20 LEFT JOIN have h ON h.alert_id = y.alert_id AND h.stream_id = e.stream_id AND h.cell = e.cell WHERE h.alert_id IS NULL GROUP BY ALL)
  SELECT alert_id, count(*) AS n FROM extra GROUP BY 1""", "surprise"))  # fmt: skip
def escalation_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many (stream, cell) each open young alert would absorb."""
    all_ = made_evidence(spark, sf_dir, 0.01)
    ev = all_.where("event_id % 300 < 100 and floor(event_id / 300) % 16 = 0").drop("event_id")
    staged = sweep.scores(ev)
    alerts = staged.select("alert_id", (F.col("alert_id") % 20).alias("region"), F.when(F.col("alert_id") % 50 < 40, NOW - 60).otherwise(NOW - 10 * 86400).alias("opened_at"), F.when(F.col("alert_id") % 7 == 0, "closed").otherwise("open").alias("status"), F.lit(0.5).alias("severity"), "stage")
    young = alerts.where((F.col("status") == "open") & (F.col("opened_at") >= NOW - 6 * 3600) & (F.col("stage") < 2)).select("alert_id", "region")
    found = all_.where("event_id % 9 = 0 and q is not null").select((F.col("event_id") % 20).alias("region"), "stream_id", "cell").distinct()
    have = ev.select("alert_id", "stream_id", "cell").distinct()
    return young.join(found, "region").join(have, ["alert_id", "stream_id", "cell"], "left_anti").groupBy("alert_id").agg(F.count("*").alias("n"))


@query(with_tables(evidence_sql("event_id % 300 < 100 AND (event_id // 300 = 3 OR event_id // 300 % 5 = 1 AND coalesce(event_id % 41 <> 0, false))", 0.01) + ", own AS (SELECT event_id % 300 AS alert_id, stream_id, cell FROM surprise WHERE event_id % 300 < 100 AND event_id // 300 = 3), extra AS (SELECT DISTINCT alert_id FROM (SELECT event_id % 300 AS alert_id, stream_id, cell FROM surprise WHERE event_id % 300 < 100 AND event_id // 300 % 5 = 1 AND event_id % 41 <> 0) x WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.alert_id = x.alert_id AND o.stream_id = x.stream_id AND o.cell = x.cell)) SELECT alert_id, stage AS new_stage, CASE WHEN stage = 2 THEN 0.95e0 ELSE 0.8e0 END AS severity FROM scored JOIN extra USING (alert_id) WHERE stage > 0 AND alert_id % 7 <> 0 AND alert_id IN (SELECT alert_id FROM own)", "surprise"))
def escalation_whole_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts whose stage rises when their own evidence and the new readings of their region are scored together."""
    all_ = made_evidence(spark, sf_dir, 0.01).where("event_id % 300 < 100")
    ev = all_.where("floor(event_id / 300) = 3").drop("event_id")
    new = all_.where("floor(event_id / 300) % 5 = 1").withColumn("region", F.col("alert_id")).drop("event_id", "alert_id")
    alerts = ev.select("alert_id").distinct().select("alert_id", F.col("alert_id").alias("region"), F.lit(NOW - 60).alias("opened_at"), F.when(F.col("alert_id") % 7 == 0, "closed").otherwise("open").alias("status"), F.lit(0.5).alias("severity"), F.lit(0).alias("stage"))
    return sweep.escalations(alerts, ev, new, NOW).select("alert_id", "new_stage", "severity")


@query(with_tables(", a AS (SELECT DISTINCT event_id % 97 AS alert_id, 'corroborated' AS policy FROM obs WHERE stream_id = 'click'), b AS (SELECT DISTINCT 200 + event_id % 13 AS alert_id, 'single' AS policy FROM obs), e AS (SELECT DISTINCT event_id % 150 AS alert_id FROM obs) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT alert_id, 'escalated' FROM e WHERE alert_id NOT IN (SELECT alert_id FROM a UNION SELECT alert_id FROM b)"))
def sweep_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    a = o.where("stream_id = 'click'").select((F.col("event_id") % 97).alias("alert_id")).distinct().withColumn("policy", F.lit("corroborated"))
    b = o.select((F.col("event_id") % 13 + 200).alias("alert_id")).distinct().withColumn("policy", F.lit("single"))
    return sweep.swept([a, b], o.select((F.col("event_id") % 150).alias("alert_id")).distinct())


@query(with_tables(", m AS (SELECT region, stream_id, cell, max(value) / 100 AS x, min(event_id % 5) AS scale FROM obs JOIN regions USING (cell) GROUP BY ALL) SELECT region, round(least(1e0, avg(x) * 0.9e0), 6) AS severity, CAST(min(scale) AS INTEGER) AS scale, string_agg(stream_id || '/' || cell, ',' ORDER BY x DESC, stream_id, cell) AS evidence FROM m GROUP BY region", "regions"))
def alert_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = obs(spark, sf_dir).join(regions(spark, sf_dir), "cell").groupBy("region", "stream_id", "cell").agg((F.max("value") / 100).alias("extremity"), F.min(F.col("event_id") % 5).cast("int").alias("scale"))
    m = m.withColumns({"bin_start": F.lit(NOW), "q": F.col("extremity"), "presence_q": F.lit(None).cast("double"), "s": F.lit(float("inf"))})
    rows = sweep.alert_rows(m, ["region"], F.avg("extremity") * 0.9, NOW)
    return rows.select("region", F.round("severity", 6).alias("severity"), "scale", F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["stream_id"], e["cell"])), ",").alias("evidence"))


@query(with_tables(f""", b AS (SELECT stream_id, cell, ts - ts % 21600 AS bin_start, count(*) AS n, avg(value) AS vmean FROM obs GROUP BY ALL), own AS (SELECT cell, stream_id, sum(n) AS observations, max(bin_start) AS latest_at, arg_max(vmean, bin_start) AS latest FROM b WHERE bin_start >= {NOW} - 259200 GROUP BY ALL),
 p AS (SELECT cell, stream_id, coalesce(q_detect, q_value) AS q, bin_start FROM surprise WHERE bin_start >= {NOW} - 259200 AND q_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell, stream_id ORDER BY greatest(coalesce(q_detect, q_value), 1 - coalesce(q_detect, q_value)) DESC, bin_start, coalesce(q_detect, q_value)) = 1),
 t AS (SELECT cell, stream_id, string_agg('l' || event_id, ',' ORDER BY i) AS stories FROM (SELECT *, row_number() OVER (PARTITION BY cell, stream_id ORDER BY event_id % 7 DESC, ts DESC, 'l' || event_id) AS i FROM obs WHERE ts BETWEEN {NOW} - 259200 AND {NOW}) WHERE i <= 5 GROUP BY ALL)
 SELECT cell, stream_id, CAST(coalesce(observations, 0) AS BIGINT) AS observations, CAST(coalesce(latest_at, 0) AS BIGINT) AS latest_at, round(latest, 6) AS latest, round(q, 6) AS peak_q, CAST(coalesce(p.bin_start, 0) AS BIGINT) AS peak_at, stories FROM own FULL JOIN p USING (cell, stream_id) LEFT JOIN t USING (cell, stream_id)""", "surprise"))  # fmt: skip
def cell_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    bins = o.groupBy("stream_id", "cell", floor_to(F.col("ts"), 21600).alias("bin_start")).agg(F.count("*").alias("n"), F.avg("value").alias("vmean")).withColumn("scale", F.lit(0))
    stories = o.select("stream_id", "cell", "ts", (F.col("event_id") % 7).alias("rank"), F.concat(F.lit("l"), F.col("event_id").cast("string")).alias("link"))
    rows = detail.cell_detail(bins, surprise(spark, sf_dir), stories, NOW - 259200, NOW)
    return rows.withColumns({"latest_at": F.coalesce("latest_at", F.lit(0).cast("long")), "peak_at": F.coalesce("peak_at", F.lit(0).cast("long")), "latest": F.round("latest", 6), "peak_q": F.round("peak_q", 6), "stories": F.array_join("stories", ",")})


@query(with_tables(f", b AS (SELECT CASE WHEN event_id % 3 = 0 AND ts >= {NOW} - 864000 THEN 'late' ELSE stream_id END AS stream_id, ts - ts % 3600 AS bin_start, count(*) AS n FROM obs WHERE stream_id <> 'error' OR ts < {NOW} - 864000 GROUP BY ALL), w AS (SELECT *, max(bin_start) OVER (PARTITION BY stream_id) AS newest FROM b) SELECT stream_id, bin_start, n, least(bin_start + 3600, {NOW}) AS observed_at FROM w WHERE CASE WHEN newest >= {NOW} - 86400 THEN bin_start >= {NOW} - 86400 ELSE bin_start = newest END"))
def overview_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of the last day; of a stalled stream its newest bin; with the time that they are from."""
    o = obs(spark, sf_dir).where(f"stream_id <> 'error' or ts < {NOW - 864000}")
    named = o.withColumn("stream_id", F.when((F.col("event_id") % 3 == 0) & (F.col("ts") >= NOW - 864000), "late").otherwise(F.col("stream_id")))
    bins = named.groupBy("stream_id", floor_to(F.col("ts"), 3600).alias("bin_start")).agg(F.count("*").alias("n"))
    return detail.recent_or_newest(bins, NOW - 86400).withColumn("observed_at", detail.observed_at(F.col("bin_start"), F.lit(3600), NOW).cast("long"))


@query(with_tables(f", al AS (SELECT DISTINCT region, {NOW} - 86400 * (1 + length(region) % 3) AS opened FROM regions), s AS (SELECT a.region, stream_id, cell, 'l' || event_id AS link, event_id % 101 AS mentions, ts FROM obs JOIN regions USING (cell) JOIN al a USING (region) WHERE ts >= opened + 1 - 172800 AND ts <= opened), c AS (SELECT *, row_number() OVER (PARTITION BY region, stream_id, cell ORDER BY mentions DESC, ts DESC, link) AS i FROM s) SELECT region AS alert_id, stream_id, link, mentions FROM c WHERE i <= 3 QUALIFY row_number() OVER (PARTITION BY region, stream_id ORDER BY mentions DESC, cell, ts DESC, link) <= 4", "regions"))
def news_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    alerts = r.select("region").distinct().select(F.col("region").alias("alert_id"), "region", (NOW - 86400 * (1 + F.length("region") % 3)).cast("long").alias("opened_at"))
    stories = obs(spark, sf_dir).join(r, "cell").select("region", "stream_id", "cell", "ts", F.concat(F.lit("l"), F.col("event_id").cast("string")).alias("link"), (F.col("event_id") % 101).alias("mentions"))
    return detail.news_in_region(alerts, stories, 172800)


@query(with_tables(", a AS (SELECT event_id AS ask_id, stream_id, cell, ts AS t0 FROM obs WHERE stream_id = 'error') SELECT ask_id, max(value) AS most, round(avg(value), 6) AS mean FROM a JOIN obs o USING (stream_id, cell) WHERE o.ts >= t0 AND o.ts < t0 + 43200 GROUP BY 1"))
def window_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    asks = o.where("stream_id = 'error'").select(F.col("event_id").alias("ask_id"), "stream_id", "cell", F.col("ts").alias("t0"), F.lit(43200).alias("width"))
    return detail.window_extremes(o.select("stream_id", "cell", "ts", "value"), asks).withColumn("mean", F.round("mean", 6))


@query(with_tables(", m AS (SELECT stream_id, cell, max(ts) AS mark FROM obs WHERE event_id % 97 = 0 GROUP BY ALL) SELECT event_id FROM obs LEFT JOIN m USING (stream_id, cell) WHERE mark IS NULL OR ts > mark"))
def beyond_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumn("bin_start", F.col("ts"))
    return detail.beyond_mark(o, o.where("event_id % 97 = 0"), ["stream_id", "cell"]).select("event_id")


def _outlines(spark: SparkSession) -> DataFrame:
    """Squares: two countries, one with a hole, and two seas, the smaller of a higher rank."""
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    rows = [("Alpha", "country", 0, 1, box(-40.0, -40.0, 0.0, 0.0)), ("Alpha", "country", 0, 1, box(-30.0, -30.0, -20.0, -20.0)), ("Beta", "country", 0, 2, box(10.0, 10.0, 30.0, 40.0)), ("Wide Sea", "sea", 1, 1, box(-60.0, -60.0, 60.0, 60.0)), ("Small Sea", "sea", 5, 2, box(0.0, 0.0, 10.0, 10.0))]
    return spark.createDataFrame(rows, "name string, kind string, rank int, ord int, ring array<struct<x:double,y:double>>")


@query("WITH p AS (SELECT event_id AS point_id, (event_id * 7 % 1270) / 10e0 - 63.45e0 AS lon, (event_id * 11 % 1390) / 10e0 - 69.45e0 AS lat FROM events) SELECT point_id, CASE WHEN lon BETWEEN -40 AND 0 AND lat BETWEEN -40 AND 0 AND NOT (lon BETWEEN -30 AND -20 AND lat BETWEEN -30 AND -20) THEN 'Alpha' WHEN lon BETWEEN 10 AND 30 AND lat BETWEEN 10 AND 40 THEN 'Beta' WHEN lon BETWEEN 0 AND 10 AND lat BETWEEN 0 AND 10 THEN 'Small Sea' WHEN lon BETWEEN -60 AND 60 AND lat BETWEEN -60 AND 60 THEN 'Wide Sea' ELSE '' END AS place FROM p")
def place_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country, else the most particular sea, that holds each point."""
    p = read(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), (F.col("event_id") * 7 % 1270 / 10 - 63.45).alias("lon"), (F.col("event_id") * 11 % 1390 / 10 - 69.45).alias("lat"))
    inside = places.containing(p, _outlines(spark)).groupBy("point_id").agg(F.min_by("name", F.struct(F.when(F.col("kind") == "country", 0).otherwise(1), -F.col("rank"), "ord")).alias("place"))
    return p.select("point_id").join(inside, "point_id", "left").withColumn("place", F.coalesce("place", F.lit("")))


@query("WITH n AS (SELECT user_id, list_distinct(list(event_type ORDER BY event_id)) AS x, list(event_type ORDER BY event_id) AS l FROM events GROUP BY 1), d AS (SELECT user_id, list_filter(l, lambda v, i: list_position(l, v) = i) AS u FROM n) SELECT user_id, array_to_string(u[1:2], ', ') || CASE WHEN len(u) > 2 THEN ' +' || (len(u) - 2) ELSE '' END AS names FROM d")
def place_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("x"))
    return own.select("user_id", places.listed(F.col("x")).alias("names"))


@query("SELECT s_suppkey, (SELECT min(n_name) FROM nation WHERE n_regionkey = s_suppkey % 7) AS cc FROM supplier")
def country_of_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("cc"), F.col("n_regionkey").cast("long").alias("cell"))
    return places.country_of_cell(read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).cast("long").alias("cell")), n).select("s_suppkey", "cc")


@query("WITH f AS (SELECT user_id % 20 AS feed, event_id % 3 AS folder, lpad(CAST(event_id * 7 % 1000 AS VARCHAR), 4, '0') AS stamp, event_id FROM events WHERE event_id % 5 <> 0), l AS (SELECT user_id % 20 AS feed, list_sort(list(DISTINCT event_id % 3), 'DESC')[1:2] AS fs FROM events GROUP BY 1) SELECT f.feed, max(stamp) AS stamp, 'h' || f.folder || '/scan_s' || max(stamp) || '_' || arg_max(lpad(CAST(event_id AS VARCHAR), 9, '0'), stamp || lpad(CAST(event_id AS VARCHAR), 9, '0')) || '.nc' AS path FROM f JOIN l ON l.feed = f.feed AND list_contains(fs, f.folder) GROUP BY f.feed, f.folder QUALIFY f.folder = max(f.folder) OVER (PARTITION BY f.feed)")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file by the stamp in its name, of the last folder or the one before it."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    stamp = F.lpad((i * 7 % 1000).cast("string"), 4, "0")
    folder = F.concat(F.lit("h"), (i % 3).cast("string"))
    name = F.when(i % 5 == 0, "index.html").otherwise(F.concat(F.lit("scan_s"), stamp, F.lit("_"), F.lpad(i.cast("string"), 9, "0"), F.lit(".nc")))
    files = e.select((F.col("user_id") % 20).alias("feed"), folder.alias("folder"), F.concat_ws("/", folder, name).alias("path"))
    return landing.newest_or_before(files, r"^scan_s(\d+)_", ["feed"], "folder")


@query(with_tables(", r AS (SELECT user_id % 50 AS feed, min(event_id) AS first, event_id % 30 AS item FROM obs GROUP BY 1, 3), n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY first) AS i FROM r WHERE item % 4 <> 0) SELECT feed, 'http://x/' || item AS link, 'g' || item || '|d' || item AS version FROM n WHERE i <= 10"))
def linked_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = (F.col("event_id") % 30).cast("string")
    text = F.concat(F.lit("<item><title>t</title><link>http://x/"), item, F.lit("</link><guid isPermaLink='false'>g"), item, F.lit("</guid><pubDate>d"), item, F.lit("</pubDate></item>"))
    own = obs(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("feed")).agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))).alias("x"))
    listings = own.select("feed", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit("</channel></rss>")).alias("body"))
    fetched = own.select("feed", F.explode(F.sequence(F.lit(0), F.lit(28), F.lit(4))).alias("k")).select("feed", F.concat(F.lit("g"), F.col("k").cast("string"), F.lit("|d"), F.col("k").cast("string")).alias("version"))
    return landing.linked_versions(listings, fetched, 10)


@query(with_tables(", p AS (SELECT user_id AS feed, event_id % 6 AS page, list(event_id) AS ids, max(event_id % 11) = 10 AND event_id % 6 = 3 AS last FROM obs GROUP BY 1, 2), w AS (SELECT *, coalesce(max(last) OVER (PARTITION BY feed ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM p) SELECT feed, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT feed, unnest(ids) AS id FROM w WHERE NOT ended AND page < 5) GROUP BY 1"))
def paged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    own = obs(spark, sf_dir).groupBy(F.col("user_id").alias("feed"), (i % 6).alias("page")).agg(F.collect_list(F.struct(i.alias("id"))).alias("results"), F.max(i % 11).alias("m"))
    pages = own.select("feed", "page", F.to_json(F.struct("results", F.when(~((F.col("m") == 10) & (F.col("page") == 3)), "next page").alias("next"))).alias("body"))
    return landing.paged(pages, "results", 5).groupBy("feed").agg(F.count("*").alias("n"), F.sum(F.get_json_object("record", "$.id").cast("long")).alias("ids"))


@query(with_tables("SELECT event_id FROM obs QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY event_id DESC) <= 500"))
def remembered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.remembered(obs(spark, sf_dir), ["stream_id"], F.desc("event_id"), 500).select("event_id")


@query(with_tables(", t AS (SELECT user_id AS batch, event_id AS target, event_id % 3 = 0 AND user_id % 4 <> 0 AS ok FROM obs) SELECT batch, target, CASE WHEN ok THEN 'b' || target END AS body FROM (SELECT *, max(ok) OVER (PARTITION BY batch) AS answered FROM t) WHERE ok OR NOT answered"))
def answered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = obs(spark, sf_dir).select(F.col("user_id").alias("batch"), i.alias("target"), F.when((i % 3 == 0) & (F.col("user_id") % 4 != 0), 200).otherwise(500).alias("status"), F.concat(F.lit("b"), i.cast("string")).alias("body"))
    return landing.readable(t)


@query(with_tables("SELECT component, ts - ts % 600 AS ts, event, min(detail) AS detail FROM health GROUP BY 1, 2, 3", "health"))
def health_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.health_rows(health(spark, sf_dir).withColumn("ts", floor_to(F.col("ts"), 600)))


@query("SELECT CAST(coalesce(sum(length(event_type)), 0) AS BIGINT) AS bytes FROM events")
def evidence_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.total_size(read(spark, sf_dir, "events").select(F.length("event_type").alias("size")))


@query("SELECT DISTINCT l_suppkey % 100 AS cell, l_linenumber AS scale FROM lineitem ORDER BY 1, 2")
def distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("cell"), F.col("l_linenumber").alias("scale")).distinct().orderBy("cell", "scale")


@query(with_tables(", c AS (SELECT stream_id, cell, count(*) AS n FROM obs GROUP BY ALL), b AS (SELECT stream_id, cell FROM c QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, cell) <= 3), k AS (SELECT stream_id, cell, ts - ts % 86400 AS w, count(*) AS n FROM obs WHERE (stream_id, cell) IN (SELECT (stream_id, cell) FROM b) GROUP BY ALL UNION ALL SELECT stream_id, 'WORLD', ts - ts % 86400, count(*) FROM obs GROUP BY ALL), days AS (SELECT DISTINCT ts - ts % 86400 AS w FROM obs), s AS (SELECT DISTINCT stream_id, cell FROM k) SELECT s.stream_id, s.cell, days.w AS win_start, coalesce(n, 0) AS n FROM s CROSS JOIN days LEFT JOIN k ON k.stream_id = s.stream_id AND k.cell = s.cell AND k.w = days.w"))
def busiest_cells_and_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the world and of a stream's three busiest cells, zeros included, for a replay."""
    from calibra.operators.fold import busiest_and_world

    return busiest_and_world(obs(spark, sf_dir), 86400, 3)


@query("WITH g AS (SELECT user_id, list({'i': event_id % 5 = 0, 's': event_id % 3 = 0, 'l': event_id % 4} ORDER BY event_id) AS e FROM events WHERE event_id % 7 < 2 GROUP BY 1) SELECT user_id, CAST(coalesce(nullif(list_position(list_transform(e, lambda x: x.i AND x.s), true), 0), nullif(list_position(list_transform(e, lambda x: x.s), true), 0), nullif(list_position(list_transform(e, lambda x: x.l > 0), true), 0), 1) - 1 AS BIGINT) AS lead FROM g")
def headline_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").where("event_id % 7 < 2").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (i % 5 == 0).alias("issued"), (i % 3 == 0).alias("story"), (i % 4).alias("level")))).alias("e"))
    return e.select("user_id", detail.headline_index(F.col("e")).cast("long").alias("lead"))


@query(with_tables(f", m AS (SELECT stream_id, ts AS received, value, ts // 900 * 900 AS w FROM obs), l AS (SELECT stream_id, {NOW} - 20 * 86400 + 137 AS opened, CASE WHEN stream_id <> 'click' THEN {NOW} - 5 * 86400 + 59 END AS closed FROM (SELECT DISTINCT stream_id FROM obs)) SELECT stream_id, w AS ts, count(*) AS n, round(avg(value), 6) AS mean FROM m JOIN l USING (stream_id) WHERE w >= opened AND (closed IS NULL OR w + 900 <= closed) GROUP BY ALL"))
def whole_link_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    links = o.select("stream_id").distinct().select("stream_id", F.lit(NOW - 20 * 86400 + 137).alias("opened"), F.when(F.col("stream_id") != "click", NOW - 5 * 86400 + 59).alias("closed"))
    return detail.whole_windows(o.select("stream_id", F.col("ts").alias("received"), "value"), links, 900).withColumn("mean", F.round("mean", 6))


@query("WITH p AS (SELECT event_id, user_id * 1e0 - 75 AS lat, (event_id % 360) * 1e0 - 180 AS lon FROM events) SELECT event_id, floor((lat + 90) / 22.5e0) * 22.5e0 - 90 AS south, floor((lon + 180) / 45e0) * 45e0 - 180 AS west, floor((lat + 90) / 22.5e0) * 22.5e0 - 90 + 11.25e0 AS mid_lat FROM p WHERE lat < 90")
def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """South-west corner and middle of the cell that holds each point."""
    from calibra.functions import geo

    p = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") - 75.0).alias("lat"), (F.col("event_id") % 360 - 180.0).alias("lon")).where("lat < 90")
    b = geo.quad_box(geo.quad_cell(F.col("lat"), F.col("lon"), 3))
    return p.select("event_id", b.alias("b")).select("event_id", "b.south", "b.west", ((F.col("b.south") + F.col("b.north")) / 2).alias("mid_lat"))
