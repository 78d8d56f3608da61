"""Hierarchical cells, distances and boxes as column arithmetic.

Cells of the hexagonal index are 64-bit numbers in hex; their resolution and their ancestors
are bit operations. Cells from coordinates are those of our own quadtree grid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth's radius in km, and km of fibre a millisecond of round trip covers.
EARTH_KM, KM_A_MS = 6371.0, 100.0


def is_cell(cell: Column) -> Column:
    return F.lower(cell).rlike("^8[0-9a-f]{14}$")


def _bits(cell: Column) -> Column:
    """The index without its leading 8 (mode), which leaves a positive long."""
    return F.conv(F.substring(F.lower(cell), 2, 14), 16, 10).cast("long")


def resolution(cell: Column) -> Column:
    """Resolution 0-15 of a cell; null for other names."""
    return F.when(is_cell(cell), F.conv(F.substring(F.lower(cell), 2, 1), 16, 10).cast("int"))


def coarsen(cell: Column, res: int) -> Column:
    """Ancestor at a resolution; names that aren't cells and cells as coarse already pass through."""
    low = 3 * (15 - res)
    bits = _bits(cell)
    body = F.shiftright(bits.bitwiseAND(F.lit((1 << 52) - 1).cast("long")), low)
    parent = F.shiftleft(body, low).bitwiseOR(F.lit((1 << low) - 1).cast("long")).bitwiseOR(F.lit(res << 52).cast("long"))
    return F.when(is_cell(cell) & (resolution(cell) > res), F.concat(F.lit("8"), F.lpad(F.lower(F.hex(parent)), 14, "0"))).otherwise(cell)


def within(cell: Column, region: Column, levels: range = range(0, 4)) -> Column:
    """Whether a cell is the region or lies in it."""
    inside = F.lit(False)
    for res in levels:
        inside = inside | ((resolution(region) == res) & (coarsen(cell, res) == region))
    return (cell == region) | F.coalesce(inside, F.lit(False))


def quad_cell(lat: Column, lon: Column, depth: int) -> Column:
    """Name of the quadtree cell of a point: 'q' and one digit 0-3 a level."""
    n = float(1 << depth)
    x = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit((1 << depth) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit((1 << depth) - 1)).cast("long")
    digits = [(F.shiftright(y, i).bitwiseAND(F.lit(1).cast("long")) * 2 + F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long"))).cast("string") for i in range(depth - 1, -1, -1)]
    return F.concat(F.lit("q"), *digits)


def quad_parent(cell: Column, depth: int) -> Column:
    return F.substring(cell, 1, depth + 1)


def quad_ancestors(cell: Column) -> Column:
    """The cell and all its ancestors, the root 'q' last."""
    return F.transform(F.sequence(F.length(cell), F.lit(1)), lambda n: F.substring(cell, F.lit(1), n))


def quad_area_share(depth: Column, leaf: int) -> Column:
    """How many leaf cells lie in a cell of a depth."""
    return F.pow(F.lit(4.0), F.lit(leaf) - depth)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def least_round_trip(km: Column) -> Column:
    """Milliseconds below which an answer from that far away is impossible, halved for doubt."""
    return 0.5 * km / KM_A_MS


def centroid(points: Column, part: str) -> Column:
    """Mean of one coordinate over a ring's vertices, the closing one included."""
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[part]) / F.size(points)


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def in_view(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point is in a map view, which may cross the antimeridian; rows without a place always are."""
    if east - west >= 360:
        inside = F.lit(True)
    else:
        w, e = (west + 180) % 360 - 180, (east + 180) % 360 - 180
        inside = lon.between(w, e) if w <= e else (lon >= w) | (lon <= e)
    return lat.isNull() | lon.isNull() | (lat.between(south, north) & inside)


def map_zoom(res: Column) -> Column:
    return F.greatest(F.least(res + 3, F.lit(10)), F.lit(3))


def quad_box(cell: Column) -> Column:
    """(south, west, north, east) of a quadtree cell, from its digits: north is the second bit, east the first."""
    digits = F.filter(F.split(F.substring(cell, 2, 64), ""), lambda d: d != "")
    start = F.struct(F.lit(-90.0).alias("south"), F.lit(-180.0).alias("west"), F.lit(180.0).alias("height"), F.lit(360.0).alias("width"))

    def down(box: Column, digit: Column) -> Column:
        d = digit.cast("int")
        north, east = F.floor(d / 2), d % 2
        return F.struct((box["south"] + north * box["height"] / 2).alias("south"), (box["west"] + east * box["width"] / 2).alias("west"), (box["height"] / 2).alias("height"), (box["width"] / 2).alias("width"))

    return F.aggregate(digits, start, down, lambda b: F.struct(b["south"].alias("south"), b["west"].alias("west"), (b["south"] + b["height"]).alias("north"), (b["west"] + b["width"]).alias("east")))


def quad_ring(cell: Column) -> Column:
    """Closed boundary ring of a cell as (longitude, latitude) pairs."""
    b = quad_box(cell)
    return F.array(*[F.array(b[x], b[y]) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])


def unwrapped(ring: Column) -> Column:
    """A ring whose longitudes span more than half of the Earth, with 360 added to the negative ones."""
    lons = F.transform(ring, lambda p: F.get(p, F.lit(0)))
    wide = F.array_max(lons) - F.array_min(lons) > 180
    return F.when(wide, F.transform(ring, lambda p: F.array(F.get(p, F.lit(0)) + F.when(F.get(p, F.lit(0)) < 0, 360.0).otherwise(0.0), F.get(p, F.lit(1))))).otherwise(ring)


def homes(text: Column) -> Column:
    """Points of a setting 'lat,lon; lat,lon'; pairs that can't be read are left out."""
    pairs = F.transform(F.split(text, ";"), lambda p: F.transform(F.split(p, ","), lambda x: F.trim(x).try_cast("double")))
    return F.filter(pairs, lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())


# Fixed values of the geostationary projection, in metres: half axes of the ellipsoid, height of the satellite over the Earth's centre.
MAJOR, MINOR, HEIGHT = 6378137.0, 6356752.31414, 42164160.0


def fixed_grid(x: Column, y: Column, lon0: float, major: float = MAJOR, minor: float = MINOR, height: float = HEIGHT) -> Column:
    """(lat, lon) seen at the scan angles x (east) and y (north), in radians, from over lon0 on the equator; null off the disc."""
    flat = (major / minor) ** 2
    a = F.sin(x) * F.sin(x) + F.cos(x) * F.cos(x) * (F.cos(y) * F.cos(y) + flat * F.sin(y) * F.sin(y))
    half = height * F.cos(x) * F.cos(y)
    root = half * half - a * (height**2 - major**2)
    away = (half - F.sqrt(root)) / a
    inward, east, north = height - away * F.cos(x) * F.cos(y), away * F.sin(x), away * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan(flat * north / F.sqrt(inward * inward + east * east)))
    lon = wrap_longitude(lon0 + F.degrees(F.atan(east / inward)))
    return F.when(root >= 0, F.struct(lat.alias("lat"), lon.alias("lon")))
