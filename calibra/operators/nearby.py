"""Pairs of places within a distance, for two large sides.

A strip of latitude is as high as the distance. Each strip is cut into as many cells of
longitude as the distance allows at its poleward edge, so cells widen towards the poles until
one goes around, and the last of a strip touches the first. A place of one side has the key of
its own cell, one of the other those of the (at most nine) cells that it can reach: a pair
meets once, whatever side of 180 degrees its places are on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.geo import EARTH_KM, haversine


def _height(km: float) -> float:
    """Degrees of latitude that a distance covers, and a little more against rounding."""
    return min(180.0, math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9)


def _cells(strip: Column, km: float) -> Column:
    """How many cells of longitude a strip has: none is narrower than what the distance reaches from it."""
    height = _height(km)
    # the farthest latitude from the equator in the strip and those beside it
    edge = F.greatest(F.abs((strip - 1) * height - 90), F.abs((strip + 2) * height - 90))
    reach = math.sin(min(km / EARTH_KM / 2, math.pi / 2)) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
    n = F.floor(math.pi / F.asin(F.least(reach, F.lit(1.0))) * (1 - 1e-9))
    return F.when((edge >= 90) | (reach >= 1), 1).otherwise(F.greatest(n, F.lit(1))).cast("long")


def cell_key(lat: Column, lon: Column, km: float) -> Column:
    """(strip, cell) of a place; longitudes may have any turn."""
    strip = F.floor((lat + 90) / _height(km))
    n = _cells(strip, km)
    return F.struct(strip.alias("strip"), F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1).alias("cell"))


def reached_keys(lat: Column, lon: Column, km: float) -> Column:
    """The different (strip, cell) that can hold a place within the distance."""
    at = F.floor((lat + 90) / _height(km))

    def of_strip(strip: Column) -> Column:
        n = _cells(strip, km)
        own = F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1)
        return F.transform(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(own + d, n))), lambda c: F.struct(strip.alias("strip"), c.alias("cell")))

    return F.flatten(F.transform(F.sequence(at - 1, at + 1), of_strip))


def within_km(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of a left place (lat, lon, ...) and a right one (to_lat, to_lon, ...) within km, with their km.

    Both sides must otherwise have different columns. Places without coordinates pair with
    nothing. A crowded cell is split by adaptive execution as any skewed key."""
    asks = left.where("lat is not null and lon is not null").withColumn("_key", F.explode(reached_keys(F.col("lat"), F.col("lon"), km)))
    held = right.withColumn("_key", cell_key(F.col("to_lat"), F.col("to_lon"), km))
    asks, held = (t.withColumns({"_strip": F.col("_key.strip"), "_cell": F.col("_key.cell")}).drop("_key") for t in (asks, held))
    pairs = asks.join(held, ["_strip", "_cell"]).drop("_strip", "_cell")
    return pairs.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))).where(F.col("km") <= km)
