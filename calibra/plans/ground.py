"""Queries: decoded rasters, scan angles, and places near each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.geo import HEIGHT, MAJOR, MINOR
from calibra.operators import nearby, raster
from calibra.plans.registry import query
from calibra.plans.tables import read
from calibra.sources.feeds import parse

_PIXELS = """WITH px AS (SELECT event_id // 1024 AS tile, event_id % 1024 // 32 AS r, event_id % 32 AS c, value, CASE WHEN event_id % 31 = 0 THEN 65535 ELSE user_id % 4 * 64 + CASE WHEN event_id % 13 = 0 THEN 1024 ELSE 0 END + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END END AS cloud, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS quality, 100 + user_id % 40 AS zenith, event_id % 24 / 8e0 AS hours FROM events),
 g AS (SELECT *, r * 0.25e0 + tile % 50 AS lat, c * 0.25e0 - 100 AS lon, coalesce({good} AND value >= 0, false) AS ok FROM px),
 b AS (SELECT tile, r // 4 AS i, c // 4 AS j, CAST(floor(avg(lat) / 3) AS VARCHAR) || '_' || CAST(floor(avg(lon) / 3) AS VARCHAR) AS cell FROM g GROUP BY ALL HAVING count(*) = 16),
 p AS (SELECT g.*, cell FROM g JOIN b ON b.tile = g.tile AND b.i = g.r // 4 AND b.j = g.c // 4)"""
_CLEAR = "cloud <> 65535 AND cloud & 1 = 0 AND (cloud >> 6) & 3 <= 1 AND cloud & 13824 = 0 AND quality = 0 AND zenith >= 108"


def _floors(step: float, shift: float = 0.0) -> raster.CellOf:
    part = lambda x: F.format_string("%.1f", F.floor((x + shift) / step).cast("double"))
    return lambda lat, lon: F.concat_ws("_", part(lat), part(lon))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel an event, in tiles of 32 by 32."""
    i, u = F.col("event_id"), F.col("user_id")
    cloud = F.when(i % 31 == 0, 65535).otherwise(u % 4 * 64 + F.when(i % 13 == 0, 1024).otherwise(0) + F.when(i % 29 == 0, 1).otherwise(0)).cast("int")
    px = read(spark, sf_dir, "events").select(F.floor(i / 1024).alias("tile"), F.floor(i % 1024 / 32).alias("row"), (i % 32).alias("col"), "value", cloud.alias("cloud"), F.when(i % 17 == 0, 1).otherwise(0).alias("quality"), (100 + u % 40).alias("zenith"), (i % 24 / 8.0).alias("hours"))
    return px.withColumns({"lat": F.col("row") * 0.25 + F.col("tile") % 50, "lon": F.col("col") * 0.25 - 100})


@query(_PIXELS.format(good="quality = 0") + " SELECT tile, cell, count(*) FILTER (ok) AS n, round(ln(1 + avg(value) FILTER (ok)), 6) AS value FROM p GROUP BY tile, cell HAVING count(*) FILTER (ok) >= 0.2e0 * count(*) AND count(*) FILTER (ok) > 0")
def raster_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cell_means(_pixels(spark, sf_dir), F.col("quality") == 0, _floors(3.0), 4).withColumn("value", F.round("value", 6))


@query(_PIXELS.format(good=_CLEAR) + " SELECT tile, cell, count(*) FILTER (ok) AS n, CAST(round_even(avg(hours) FILTER (ok) * 3600, 0) AS BIGINT) AS seconds, round(ln(1 + greatest(avg(value) FILTER (ok) - quantile_cont(value, 0.1) FILTER (ok), 0)), 6) AS value FROM p GROUP BY tile, cell HAVING count(*) FILTER (ok) >= 0.2e0 * count(*) AND count(*) FILTER (ok) > 0")
def raster_cell_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = raster.clear_night(F.col("cloud"), F.col("quality"), F.col("zenith"))
    return raster.cell_excess(_pixels(spark, sf_dir), good, _floors(3.0), 4).withColumn("value", F.round("value", 6))


_FLAT = (MAJOR / MINOR) ** 2
_FIRES = f"""WITH s AS (SELECT event_id AS ord, -0.14e0 + 0.0028e0 * (event_id * 7 % 101) AS x, 0.14e0 - 0.0028e0 * (user_id % 101) AS y, value, event_id // 1000 * 300 AS start FROM events WHERE event_id % 40 IN (10, 11, 12, 13, 14, 30, 31, 32, 33, 34)),
 a AS (SELECT *, sin(x) ** 2 + cos(x) ** 2 * (cos(y) ** 2 + {_FLAT!r} * sin(y) ** 2) AS a, {HEIGHT!r} * cos(x) * cos(y) AS h FROM s),
 d AS (SELECT *, (h - sqrt(h * h - a * {HEIGHT**2 - MAJOR**2!r})) / a AS away FROM a WHERE h * h - a * {HEIGHT**2 - MAJOR**2!r} >= 0),
 v AS (SELECT ord, start, value, away * sin(x) AS e, away * cos(x) * sin(y) AS n, {HEIGHT!r} - away * cos(x) * cos(y) AS i FROM d),
 g AS (SELECT ord, start, value, degrees(atan({_FLAT!r} * n / sqrt(i * i + e * e))) AS lat, degrees(atan(e / i)) - 75 AS lon FROM v),
 c AS (SELECT *, CAST(floor((lat + 90.3e0) / 5) AS VARCHAR) || '_' || CAST(floor((CASE WHEN lon < -180 THEN lon + 360 ELSE lon END + 90.3e0) / 5) AS VARCHAR) AS cell FROM g),
 k AS (SELECT *, row_number() OVER (PARTITION BY cell, start ORDER BY ord) - 1 AS k FROM c) SELECT 'fires' AS stream_id, cell, CAST(start + k AS BIGINT) AS ts, CASE WHEN value >= 0 THEN value ELSE 0 END AS value FROM k WHERE k < 2"""  # fmt: skip


@query(_FIRES)
def scan_angle_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires of geostationary scans: one pixel an event, a scan a thousand of them that spans two seconds."""
    i = F.col("event_id")
    start = F.floor(i / 1000) * 300
    px = read(spark, sf_dir, "events").select(i.alias("ord"), (-0.14 + 0.0028 * (i * 7 % 101)).alias("x"), (0.14 - 0.0028 * (F.col("user_id") % 101)).alias("y"), (i % 40).alias("mask"), F.col("value").alias("power"), start.alias("start"), (start + 2).alias("end"))
    return parse("scan_fires", px, stream="fires", cell_of=_floors(5.0, 90.3), lon0=-75.0)


_PLACE = "SELECT event_id AS {id}, user_id * 37 % 17000 / 1e2 - 85 AS {lat}, event_id * 173 % 36000 / 1e2 - 180 AS {lon} FROM events WHERE event_type = '{type}'"
_NEAR = 150.0


@query("WITH l AS (" + _PLACE.format(id="event_id", lat="lat", lon="lon", type="error") + "), r AS (" + _PLACE.format(id="to_id", lat="to_lat", lon="to_lon", type="signup") + f"), d AS (SELECT event_id, to_id, 2 * 6371e0 * asin(sqrt(least(sin(radians(to_lat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(to_lat)) * sin(radians(to_lon - lon) / 2) ** 2, 1))) AS km FROM l JOIN r ON to_lat >= lat - {math.degrees(_NEAR / 6371) + 0.01!r} AND to_lat <= lat + {math.degrees(_NEAR / 6371) + 0.01!r}) SELECT event_id, to_id, round(km, 3) AS km FROM d WHERE km <= {_NEAR}")
def places_within_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an error and a sign-up within 150 km, over latitudes near both poles and across 180 degrees."""
    e = read(spark, sf_dir, "events")
    lat, lon = F.col("user_id") * 37 % 17000 / 100.0 - 85, F.col("event_id") * 173 % 36000 / 100.0 - 180
    left = e.where("event_type = 'error'").select("event_id", lat.alias("lat"), lon.alias("lon"))
    right = e.where("event_type = 'signup'").select(F.col("event_id").alias("to_id"), lat.alias("to_lat"), lon.alias("to_lon"))
    return nearby.within_km(left, right, _NEAR).select("event_id", "to_id", F.round("km", 3).alias("km"))
