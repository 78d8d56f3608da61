"""Distances, scan angles and rasters against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F


def km_between(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_pairs_within_a_distance_equal_all_pairs(spark):
    """Poles, both sides of 180 degrees, longitudes of another turn, nulls, repeated rows; small and large distances."""
    from calibra.operators.nearby import within_km

    rng = np.random.default_rng(2)
    spots = [(90.0, 0.0), (-90.0, 50.0), (89.9, 180.0), (89.9, -0.5), (0.0, 180.0), (0.0, -180.0), (0.3, 179.9), (10.0, 540.0), (-45.0, -179.99), (-45.1, 179.99)]
    spots += [(float(x), float(y)) for x, y in zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 150))), rng.uniform(-180, 180, 150))] + [(float(x), float(y)) for x, y in zip(rng.uniform(85, 90, 60), rng.uniform(-180, 180, 60))]
    left = spark.createDataFrame([*enumerate(spots), (900, (None, 1.0)), (4, spots[4])], "id long, p struct<a double, b double>").select("id", F.col("p.a").alias("lat"), F.col("p.b").alias("lon"))
    right = left.select(F.col("id").alias("to_id"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    for km in (5.0, 120.0, 900.0, 9_000.0, 30_000.0):
        want = sorted((i, j) for i in [*range(len(spots)), 4] for j in [*range(len(spots)), 4] if km_between(spots[i], spots[j]) <= km)
        assert sorted((r.id, r.to_id) for r in within_km(left, right, km).collect()) == want


def test_scan_angles_give_the_published_point(spark):
    from calibra.functions.geo import fixed_grid

    rows = spark.createDataFrame([(-0.024052, 0.095340), (0.0, 0.0), (0.2, 0.0)], "x double, y double").select(fixed_grid(F.col("x"), F.col("y"), -75.0).alias("p")).collect()
    assert abs(rows[0].p.lat - 33.846162) < 1e-5 and abs(rows[0].p.lon + 84.690932) < 1e-5
    assert abs(rows[1].p.lat) < 1e-12 and abs(rows[1].p.lon + 75) < 1e-12 and rows[2].p is None


def test_cells_of_a_raster_equal_plain_arrays(spark):
    """Blocks that aren't whole are left out, pixels that fail one bit don't count, thin cells give nothing."""
    from calibra.operators.raster import cell_excess, cell_means, clear_night

    rng, size = np.random.default_rng(4), 4
    n = 18  # the last two rows and columns are trimmed
    cloud = rng.choice([0, 1, 64, 128, 192, 512, 1024, 4096, 8192, 65535], size=(n, n), p=[0.5, 0.05, 0.2, 0.05, 0.05, 0.03, 0.03, 0.03, 0.03, 0.03])
    value, hours, quality, zenith = rng.uniform(-1, 30, (n, n)), rng.uniform(0, 3, (n, n)), (rng.random((n, n)) < 0.1).astype(int), np.where(rng.random((n, n)) < 0.1, 100.0, 120.0)
    quality[:4, :4] = 1
    value[5, 5], value[6, 6] = np.nan, None
    rows = [(1, i, j, i * 1.0, j * 1.0, None if (i, j) == (6, 6) else float(value[i, j]), float(hours[i, j]), int(cloud[i, j]), int(quality[i, j]), float(zenith[i, j])) for i in range(n) for j in range(n)]
    px = spark.createDataFrame(rows, "tile long, row int, col int, lat double, lon double, value double, hours double, cloud int, quality int, zenith double")
    cell_of = lambda lat, lon: F.concat_ws("_", F.floor(lat / 8), F.floor(lon / 4))
    ok = (cloud != 65535) & ((cloud & 1) == 0) & (((cloud >> 6) & 3) <= 1) & ((cloud & 0b11011000000000) == 0) & (quality == 0) & (zenith >= 108)
    means, excess = {}, {}
    for i in range(2):
        for j in range(4):
            here = np.s_[8 * i : 8 * i + 8, size * j : size * j + size]
            for good, out in (((quality == 0), means), (ok, excess)):
                v = value[here][good[here] & (value[here] >= 0)]
                if len(v) and len(v) >= 0.5 * 32:
                    out[f"{i}_{j}"] = (len(v), float(np.log1p(v.mean() if out is means else v.mean() - np.percentile(v, 10))))
    for got, want in ((cell_means(px, F.col("quality") == 0, cell_of, size, 0.5), means), (cell_excess(px, clear_night(F.col("cloud"), F.col("quality"), F.col("zenith")), cell_of, size, 0.5), excess)):
        found = {r.cell: (r.n, r.value) for r in got.collect()}
        assert found.keys() == want.keys() and want and all(found[c][0] == want[c][0] and abs(found[c][1] - want[c][1]) < 1e-9 for c in want)
    assert cell_means(px.limit(0), F.lit(True), cell_of).count() == 0
