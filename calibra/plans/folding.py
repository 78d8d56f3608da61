"""Queries: time bins, folds, zero-filled windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import bins, geo, keys, pit, text, times
from calibra.operators import fold
from calibra.plans.registry import query
from calibra.plans.tables import NOW, first_seen, obs, read, surprise, with_tables

_SCALE = f"CAST(floor(log2(CAST(({NOW} - ts) // 300 + 1 AS DOUBLE))) AS INTEGER)"


@query(with_tables(f""", b AS (SELECT *, {_SCALE} AS scale FROM obs WHERE {NOW} - ts >= 900), k AS (SELECT *, ts - ts % (300 * CAST(pow(2, scale) AS BIGINT)) AS bin_start FROM b)
SELECT stream_id, cell, scale, bin_start, count(*) AS n, count(value) AS n_values, min(value) AS vmin, max(value) AS vmax, round(avg(value), 6) AS vmean, round(var_pop(value) * count(value), 6) AS m2 FROM k GROUP BY ALL"""))  # fmt: skip
def cascade_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.cascade_fold(obs(spark, sf_dir), NOW).withColumn("vmean", F.round("vmean", 6)).withColumn("m2", F.round("m2", 6))


@query(with_tables(""", h AS (SELECT stream_id, cell, ts - ts % 86400 AS bin_start, value FROM obs)
SELECT stream_id, cell, bin_start, count(*) AS n, count(value) AS n_values, min(value) AS vmin, max(value) AS vmax, round(avg(value), 6) AS vmean, round(var_pop(value) * count(value), 6) AS m2 FROM h GROUP BY ALL"""))  # fmt: skip
def moments_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two runs merged equal the bins of one run."""
    by = ["stream_id", "cell", "bin_start"]
    rows = obs(spark, sf_dir).withColumn("bin_start", bins.floor_to(F.col("ts"), 86400))

    def part(r: DataFrame) -> DataFrame:
        return r.groupBy(*by).agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.avg("value").alias("vmean"), (F.var_pop("value") * F.count("value")).alias("m2"))

    merged = fold.merge_bins(part(rows.where("event_id % 3 = 0")), part(rows.where("event_id % 3 <> 0")), keys=by)
    return merged.withColumn("vmean", F.round("vmean", 6)).withColumn("m2", F.round("m2", 6))


@query(with_tables(f""", g AS (SELECT stream_id, cell, unnest(generate_series({NOW} - 172800, {NOW} - 3600, 3600)) AS win_start FROM (SELECT DISTINCT stream_id, cell FROM obs)), c AS (SELECT stream_id, cell, ts - ts % 3600 AS win_start, count(*) AS n FROM obs WHERE ts >= {NOW} - 172800 AND ts < {NOW} GROUP BY ALL)
SELECT g.stream_id, g.cell, g.win_start, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (stream_id, cell, win_start)"""))  # fmt: skip
def native_windows_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.native_windows(obs(spark, sf_dir), 3600, NOW - 172800, NOW).select("stream_id", "cell", "win_start", "n")


@query(with_tables(f""", a AS (SELECT *, ts + event_id * 37 % 600 AS fs FROM obs), cl AS (SELECT stream_id, cell, min(fs - fs % 21600) AS first, max(fs) AS latest FROM a GROUP BY ALL HAVING max(fs) >= {NOW} - 2592000 AND min(fs - fs % 21600) <= ({NOW} - 60 - 21600) // 21600 * 21600),
d AS (SELECT stream_id, cell, unnest(generate_series(first, CAST(({NOW} - 60 - 21600) // 21600 * 21600 AS BIGINT), 21600)) AS win_start FROM cl), c AS (SELECT stream_id, cell, fs - fs % 21600 AS win_start, count(*) AS n FROM a GROUP BY ALL)
SELECT d.stream_id, d.cell, d.win_start, coalesce(c.n, 0) AS n FROM d LEFT JOIN c USING (stream_id, cell, win_start)"""))  # fmt: skip
def due_windows_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.due_windows(first_seen(obs(spark, sf_dir)), "first_seen", 21600, NOW).select("stream_id", "cell", "win_start", "n")


@query(with_tables("SELECT stream_id, cell, min(ts - ts % 900) AS first_window FROM obs GROUP BY ALL"))
def first_window_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).groupBy("stream_id", "cell").agg(F.min(bins.floor_to(F.col("ts"), 900)).alias("first_window"))


@query(with_tables(f"SELECT event_id, {_SCALE} AS scale, ts - ts % (300 * CAST(pow(2, {_SCALE}) AS BIGINT)) AS bin_start, 300 * CAST(pow(2, {_SCALE}) AS BIGINT) - 300 AS from_age, 300 * CAST(pow(2, {_SCALE} + 1) AS BIGINT) - 300 AS to_age FROM obs WHERE ts <= {NOW}"))
def scale_for_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).where(F.col("ts") <= NOW)
    s = bins.scale_for_age(F.lit(NOW) - F.col("ts"))
    lo, hi = bins.scale_ages(s)
    return o.select("event_id", s.alias("scale"), bins.bin_start(F.col("ts"), s).alias("bin_start"), lo.alias("from_age"), hi.alias("to_age"))


@query(with_tables("SELECT event_id, CAST((ts // 3600) % 24 AS INTEGER) AS hour, CAST((ts // 86400 + 4) % 7 AS INTEGER) AS dow FROM obs"))
def hour_dow_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("event_id", bins.hour_of_day(F.col("ts")).alias("hour"), bins.day_of_week(F.col("ts")).alias("dow"))


@query("SELECT event_id, CAST(('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 600 AS offset8, CAST(('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 6)) AS BIGINT) % 600 AS offset6 FROM events")
def id_offset_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    return read(spark, sf_dir, "events").select("event_id", keys.stable_offset(k, 600).alias("offset8"), keys.stable_offset(k, 600, 6).alias("offset6"))


_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(stream_id || '|' || cell, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])), lambda a, k: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"
_JITTER = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(stream_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda acc, x: (acc * 131 + x) % 4294967296) % 360"


@query(with_tables(f"SELECT stream_id, cell, {_CRC} AS seed, {_JITTER} AS jitter FROM (SELECT DISTINCT stream_id, cell FROM obs)"))
def seeds_and_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC seeds and poll jitter of every series."""
    o = obs(spark, sf_dir).select("stream_id", "cell").distinct()
    return o.select("stream_id", "cell", keys.cell_seed(F.col("stream_id"), F.col("cell")).alias("seed"), keys.jitter(F.col("stream_id"), F.lit(3600)).alias("jitter"))


_Q = "CASE WHEN event_id % 7 = 0 THEN (1 - exp(-value / 50e0)) * 0.99e0 ELSE 1 - exp(-value / 50e0) END"


@query(f"WITH e AS (SELECT event_id, {_Q} AS q, CASE event_id % 3 WHEN 0 THEN 'upper' WHEN 1 THEN 'lower' ELSE 'both' END AS tail FROM events), p AS (SELECT *, least(greatest(CASE tail WHEN 'upper' THEN 1 - q WHEN 'lower' THEN q ELSE 2 * least(q, 1 - q) END, 1e-300), 1e0) AS p FROM e) SELECT event_id, round(p, 9) AS p, round(-ln(p), 6) AS surprisal, round(CASE tail WHEN 'upper' THEN greatest(q, 0.5e0) WHEN 'lower' THEN greatest(1 - q, 0.5e0) ELSE greatest(q, 1 - q) END, 9) AS extremity, CAST(greatest(least(floor(q * 10), 9), 0) AS INTEGER) AS decile, CASE WHEN greatest(q, 1 - q) < 0.9e0 THEN 'typical' WHEN greatest(q, 1 - q) < 0.99e0 THEN 'unusual' ELSE 'rare' END AS word FROM p")
def tail_p_one_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    q0 = 1 - F.exp(-F.col("value") / 50.0)
    e = read(spark, sf_dir, "events").select("event_id", pit.detection_q(F.when(F.col("event_id") % 7 == 0, q0 * 0.99), q0).alias("q"), F.when(F.col("event_id") % 3 == 0, "upper").when(F.col("event_id") % 3 == 1, "lower").otherwise("both").alias("tail"))
    q, t = F.col("q"), F.col("tail")
    return e.select("event_id", F.round(pit.tail_p(q, t), 9).alias("p"), F.round(pit.surprisal(q, t), 6).alias("surprisal"), F.round(pit.tail_extremity(q, t), 9).alias("extremity"), pit.decile(q).alias("decile"), pit.rarity_word(q).alias("word"))


@query("WITH e AS (SELECT event_id, 1 - exp(-value / 50e0) AS hi, (1 - exp(-value / 50e0)) * 0.9e0 AS lo FROM events) SELECT event_id, round(CASE WHEN lo > 0.5e0 THEN lo WHEN hi < 0.5e0 THEN hi ELSE 0.5e0 END, 9) AS q_detect, CASE WHEN least(hi, 1 - hi) <= 1e-6 THEN 'over 1-in-1M' ELSE '1-in-' || CAST(CAST(round(1 / least(hi, 1 - hi)) AS BIGINT) AS VARCHAR) END || ' ' || CASE WHEN hi > 0.5e0 THEN 'high' ELSE 'low' END AS odds FROM e")
def conservative_q_and_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi = 1 - F.exp(-F.col("value") / 50.0)
    return read(spark, sf_dir, "events").select("event_id", F.round(pit.conservative_q(hi * 0.9, hi), 9).alias("q_detect"), pit.rarity_odds(hi).alias("odds"))


@query("SELECT event_id, round(ln(greatest(value, 1e-12)), 9) AS logged, round(ln(1 + greatest(value, 0e0)), 9) AS logged1, round(exp(ln(greatest(value, 1e-12))), 6) AS back, round(100 * (exp(ln(1 + greatest(value, 0e0))) - 1), 4) AS percent, round(ln(1 + greatest(value - 0.5e0, 0e0)), 9) AS edge_lo, round(ln(1 + greatest(value + 0.5e0, 0e0)), 9) AS edge_hi FROM events")
def value_transform_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    lo, hi = pit.quantum_edges(v, 1.0, "log1p")
    r = lambda c, d, n: F.round(c, d).alias(n)
    return read(spark, sf_dir, "events").select("event_id", r(pit.transform(v, "log"), 9, "logged"), r(pit.transform(v, "log1p"), 9, "logged1"), r(pit.inverse(pit.transform(v, "log"), "log"), 6, "back"), r(pit.inverse(pit.transform(v, "log1p"), "log1p", True), 4, "percent"), r(lo, 9, "edge_lo"), r(hi, 9, "edge_hi"))


@query(with_tables("SELECT event_id, CASE stream_id WHEN 'error' THEN value WHEN 'purchase' THEN value ELSE CAST(1 AS DOUBLE) END AS scored, CAST(CASE WHEN stream_id IN ('error', 'purchase') THEN 0 ELSE greatest(300, 60 * (event_id % 20)) END AS BIGINT) AS width FROM obs"))
def scored_value_and_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    flavor = F.when(F.col("stream_id").isin("error", "purchase"), "continuous").otherwise("count")
    return obs(spark, sf_dir).select("event_id", pit.scored_value(flavor, F.lit(1), F.col("value")).alias("scored"), bins.row_width(flavor, F.lit(None).cast("long"), F.col("event_id") % 20 * 60).alias("width"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS domain, CASE WHEN regexp_matches(url, '^https?://') THEN url END AS link FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"), text.valid_link(F.col("url")).alias("link"))


@query(r"""WITH u AS (SELECT doc_id, 'https://news.example.org/' || source || '/' || regexp_replace(lower(substr(text, 1, 40)), '[^a-z]+', '-', 'g') || '-20240131.html?x=1' AS url FROM documents),
s AS (SELECT doc_id, list_transform(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '\.[A-Za-z0-9]{1,5}$', ''), '[-_+]+', ' ', 'g'), '\b[0-9]{4,}\b', '', 'g'))) AS w FROM u),
b AS (SELECT doc_id, list_filter(w, lambda x: len(regexp_split_to_array(x, '\s+')) >= 3) AS l FROM s), c AS (SELECT doc_id, l, list_sort(list_transform(l, lambda x: {'n': -length(x), 's': x}))[1].s AS best FROM b)
SELECT doc_id, CASE WHEN len(l) > 0 THEN substr(upper(substr(best, 1, 1)) || substr(best, 2, 400), 1, 160) END AS headline FROM c""")  # fmt: skip
def headline_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_replace(F.lower(F.substring("text", 1, 40)), "[^a-z]+", "-")
    url = F.concat(F.lit("https://news.example.org/"), F.col("source"), F.lit("/"), slug, F.lit("-20240131.html?x=1"))
    return read(spark, sf_dir, "documents").select("doc_id", text.headline(url).alias("headline"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(o_orderdate) AS BIGINT) AS from_iso, CAST(epoch(o_orderdate) AS BIGINT) - 7200 AS from_offset, CAST(epoch(o_orderdate) AS BIGINT) AS from_ms, CAST(NULL AS BIGINT) AS from_junk FROM orders")
def parse_time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    sec = bins.epoch("o_orderdate")
    iso = times.stamp(sec)
    return o.select("o_orderkey", iso.alias("iso"), times.parse_time(iso).alias("from_iso"), times.parse_time(F.replace(iso, F.lit("Z"), F.lit("+02:00"))).alias("from_offset"), times.parse_time((sec * 1000).cast("string"), "epoch").alias("from_ms"), times.parse_time(F.lit("soon")).alias("from_junk"))


def _h3(c):
    return F.concat(F.lit("83"), F.lpad(F.lower(F.hex(F.pmod(c * 2654435761, F.lit(1 << 16)))), 4, "0"), F.lit("fffffffff"))


_CELL = "('83' || lpad(lower(to_hex(event_id * 2654435761 % 65536)), 4, '0') || 'fffffffff')"


@query(f"""WITH c AS (SELECT event_id, {_CELL} AS cell, CAST('0x' || {_CELL} AS UBIGINT) AS h FROM events)
SELECT event_id, cell, 3 AS res, lower(to_hex((h & ~(CAST(15 AS UBIGINT) << 52)) | (CAST(2 AS UBIGINT) << 52) | ((CAST(1 AS UBIGINT) << 39) - 1))) AS parent2, lower(to_hex((h & ~(CAST(15 AS UBIGINT) << 52)) | (CAST(0 AS UBIGINT) << 52) | ((CAST(1 AS UBIGINT) << 45) - 1))) AS parent0, cell AS parent5 FROM c""")  # fmt: skip
def coarsen_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "events").select("event_id", _h3(F.col("event_id")).alias("cell"))
    return c.select("event_id", "cell", geo.resolution(F.col("cell")).alias("res"), geo.coarsen(F.col("cell"), 2).alias("parent2"), geo.coarsen(F.col("cell"), 0).alias("parent0"), geo.coarsen(F.col("cell"), 5).alias("parent5"))


@query("WITH p AS (SELECT event_id, user_id * 1.1e0 - 80 AS lat, (event_id % 360) * 1e0 - 180 AS lon FROM events), d AS (SELECT event_id, 6371e0 * 2 * asin(sqrt(least(pow(sin(radians(lat - 48.2e0) / 2), 2) + cos(radians(48.2e0)) * cos(radians(lat)) * pow(sin(radians(lon - 16.4e0) / 2), 2), 1e0))) AS km, lat, lon FROM p) SELECT event_id, round(km, 4) AS km, round(0.5e0 * km / 100, 6) AS least_ms, (lat BETWEEN -30 AND 60) AND (lon >= 150 OR lon <= -120) AS in_view FROM d")
def great_circle_and_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 1.1 - 80).alias("lat"), (F.col("event_id") % 360 - 180.0).alias("lon"))
    km = geo.haversine(F.lit(48.2), F.lit(16.4), F.col("lat"), F.col("lon"))
    return p.select("event_id", F.round(km, 4).alias("km"), F.round(geo.least_round_trip(km), 6).alias("least_ms"), geo.in_view(F.col("lat"), F.col("lon"), 150.0, -30.0, 240.0, 60.0).alias("in_view"))


_X = "least(CAST(floor(((event_id % 360) * 1e0 - 180 + 180) / 360 * 8) AS BIGINT), 7)"
_Y = "least(CAST(floor((user_id % 90 + 0.5e0 + 90) / 180 * 8) AS BIGINT), 7)"


@query(f"WITH c AS (SELECT event_id, {_X} AS x, {_Y} AS y FROM events) SELECT event_id, 'q' || CAST((y >> 2 & 1) * 2 + (x >> 2 & 1) AS VARCHAR) || CAST((y >> 1 & 1) * 2 + (x >> 1 & 1) AS VARCHAR) || CAST((y & 1) * 2 + (x & 1) AS VARCHAR) AS cell, 'q' || CAST((y >> 2 & 1) * 2 + (x >> 2 & 1) AS VARCHAR) AS top, CAST(4 AS BIGINT) AS n_ancestors FROM c")
def quad_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", geo.quad_cell(F.col("user_id") % 90 + 0.5, F.col("event_id") % 360 - 180.0, 3).alias("cell"))
    return e.select("event_id", "cell", geo.quad_parent(F.col("cell"), 1).alias("top"), F.size(geo.quad_ancestors(F.col("cell"))).cast("long").alias("n_ancestors"))


@query(f"""WITH c AS (SELECT event_id, event_type AS stream_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, {_X} AS x, {_Y} AS y FROM events), q AS (SELECT stream_id, ts - ts % 86400 AS win_start, 'q' || CAST((y >> 2 & 1) * 2 + (x >> 2 & 1) AS VARCHAR) || CAST((y >> 1 & 1) * 2 + (x >> 1 & 1) AS VARCHAR) || CAST((y & 1) * 2 + (x & 1) AS VARCHAR) AS cell FROM c),
a AS (SELECT stream_id, win_start, unnest([substr(cell, 1, 1), substr(cell, 1, 2), substr(cell, 1, 3), cell]) AS node FROM q) SELECT stream_id, node, win_start, count(*) AS n FROM a GROUP BY ALL""")  # fmt: skip
def counts_up_the_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), bins.epoch("ts").alias("ts"), geo.quad_ancestors(geo.quad_cell(F.col("user_id") % 90 + 0.5, F.col("event_id") % 360 - 180.0, 3)).alias("ancestors"))
    return fold.counts_up_the_tree(e, "ancestors", 86400)


@query()
def kll_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and tails of each stream's values from merged sketches; rank error is tested."""
    s = fold.with_sketch(obs(spark, sf_dir), ["stream_id", "cell"]).groupBy("stream_id").agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    return s.select("stream_id", *[F.expr(f"kll_sketch_get_quantile_double(sketch, {q})").alias(n) for q, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))])


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal * 1000) >= 1e6 THEN printf('%.1f', c_acctbal * 1000 / 1e6) || 'M' ELSE format('{:,.2f}', c_acctbal * 1000) END AS money FROM customer")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_acctbal") * 1000
    return read(spark, sf_dir, "customer").select("c_custkey", text.fmt_number(v, 2).alias("money"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || CASE WHEN p_size > 20 THEN ', size ' || CAST(p_size AS VARCHAR) ELSE '' END, '\\s+', ' ', 'g')) AS summary, CASE WHEN p_size > 20 THEN 'https://maps.example.org/' || replace(p_name, ' ', '+') || '?s=' || CAST(p_size AS VARCHAR) END AS link FROM part")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") > 20, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", text.template([("%s", [F.col("p_name")]), (", size %d", [size])]).alias("summary"), text.fill_link("https://maps.example.org/{name}?s={size}", {"name": F.col("p_name"), "size": size}).alias("link"))


@query(with_tables("SELECT event_id, round(coalesce(greatest(q_value, 1 - q_value), presence_q), 9) AS extremity FROM surprise", "surprise"))
def row_extremity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surprise(spark, sf_dir)
    return s.select("event_id", F.round(pit.row_extremity(F.col("q_value"), F.col("presence_q"), F.lit("both")), 9).alias("extremity"))
