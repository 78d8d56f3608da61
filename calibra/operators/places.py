"""Names of places: points in outlines, the nearest outline, and lists of names.

Outlines are a dimension (name, kind, rank, ord, ring: array of (x, y)). Edges are exploded
once and keyed by one-degree strips of latitude, so a point meets only the edges that its
parallel can cross; no side is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.operators import nearby


def _edges(outlines: DataFrame) -> DataFrame:
    rows = outlines.select("name", "kind", "rank", "ord", F.posexplode("ring").alias("i", "a"), "ring")
    after = F.get("ring", F.pmod(F.col("i") + 1, F.size("ring")).cast("int"))
    return rows.select("name", "kind", "rank", "ord", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), after["x"].alias("x2"), after["y"].alias("y2"))


def containing(points: DataFrame, outlines: DataFrame) -> DataFrame:
    """(point_id, name, kind, rank, ord) of each outline that holds a point, by the even-odd rule over all its rings."""
    strip = F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))))
    edges = _edges(outlines).where("y1 <> y2").withColumn("strip", strip)
    hit = points.withColumn("strip", F.floor("lat")).join(edges, "strip").where((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat")))
    crossed = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    odd = hit.groupBy("point_id", "name", "kind", "rank", "ord").agg((F.count_if(F.col("lon") < crossed) % 2).alias("odd"))
    return odd.where("odd = 1").drop("odd")


def nearest(points: DataFrame, outlines: DataFrame, kind: str, within_km: float) -> DataFrame:
    """(point_id, near): the outline of a kind with the closest outline point within a distance.

    Points meet the outline points of the cells that the distance can reach."""
    corners = outlines.where(F.col("kind") == kind).select("name", "ord", F.explode("ring").alias("p")).select("name", "ord", F.col("p.x").alias("to_lon"), F.col("p.y").alias("to_lat"))
    close = nearby.within_km(points.select("point_id", "lat", "lon"), corners, within_km)
    return close.groupBy("point_id").agg(F.min_by("name", F.struct("km", "ord")).alias("near"))


def place_names(points: DataFrame, outlines: DataFrame, coast_km: float = 30.0, off_km: float = 150.0) -> DataFrame:
    """(point_id, place): the country that holds a point, else its most particular sea ('off' a near country), else the nearest of either, else ''."""
    inside = containing(points, outlines)
    country = inside.where("kind = 'country'").groupBy("point_id").agg(F.min_by("name", "ord").alias("country"))
    sea = inside.where("kind = 'sea'").groupBy("point_id").agg(F.min_by("name", F.struct(-F.col("rank"), "ord")).alias("sea"))
    out = points.select("point_id").join(country, "point_id", "left").join(sea, "point_id", "left")
    for column, kind, km in (("off", "country", off_km), ("coast", "country", coast_km), ("water", "sea", off_km)):
        out = out.join(nearest(points, outlines, kind, km).withColumnRenamed("near", column), "point_id", "left")
    at_sea = F.when(F.col("off").isNotNull(), F.concat("sea", F.lit(", off "), "off")).otherwise(F.col("sea"))
    name = F.when(F.col("country").isNotNull(), F.col("country")).when(F.col("sea").isNotNull(), at_sea).otherwise(F.coalesce("coast", "water", F.lit("")))
    return out.select("point_id", name.alias("place"))


def listed(names: Column, most: int = 2) -> Column:
    """Distinct names in their order, 'Finland, Estonia +1'; empty ones don't count."""
    known = F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))
    more = F.size(known) - most
    return F.concat(F.array_join(F.slice(known, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def country_of_cell(cells: DataFrame, countries: DataFrame) -> DataFrame:
    """cells with cc, the first country in order of code whose representative cell it is."""
    return cells.join(countries.groupBy("cell").agg(F.min("cc").alias("cc")), "cell", "left")
