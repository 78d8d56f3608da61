"""Cells of decoded raster pixels: screening by quality words, block sums, a cell's own background.

Pixels have tile, row, col, lat, lon, value and what their screening needs. A block is a square
of neighbouring pixels and lies in the cell of its centre. Blocks at an edge that aren't whole
are left out, so every pixel of a tile must have its row, valid or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CellOf = Callable[[Column, Column], Column]

# Fixed values of the cloud word: the fill value, the bit set by day, the lowest of two bits of
# confidence, the bits that refuse a pixel; the least solar zenith of a night.
FILL, DAY, CONFIDENCE, REFUSED, NIGHT = 65535, 0, 6, (9, 10, 12, 13), 108.0


def clear_night(cloud: Column, quality: Column, zenith: Column, most_cloud: int = 1) -> Column:
    """Whether a pixel was seen at night, without cloud and without a fault."""
    refused = (1 << DAY) | sum(1 << b for b in REFUSED)
    clear = (cloud != FILL) & (cloud.bitwiseAND(F.lit(refused)) == 0) & (F.shiftright(cloud, CONFIDENCE).bitwiseAND(F.lit(3)) <= most_cloud)
    return F.coalesce(clear & (quality == 0) & (zenith >= NIGHT), F.lit(False))


def _blocks(pixels: DataFrame, size: int, cell_of: CellOf, *gathered: Column) -> DataFrame:
    """Whole blocks: tile, cell and the gathered aggregates."""
    at = [F.floor(F.col(c) / size).alias(f"block_{c}") for c in ("row", "col")]
    sums = pixels.groupBy("tile", *at).agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.count("*").alias("_pixels"), *gathered)
    return sums.where(F.col("_pixels") == size * size).withColumn("cell", cell_of(F.col("_lat"), F.col("_lon")))


def cell_means(pixels: DataFrame, good: Column, cell_of: CellOf, size: int = 16, least: float = 0.2, log: bool = True) -> DataFrame:
    """(tile, cell, n, value): mean of a cell's good pixels where a least share of its pixels is good.

    Good pixels below zero or without a value don't count. Sums of blocks come first, so what is
    shuffled by cell is a row a block."""
    ok = F.coalesce(good & (F.col("value") >= 0) & ~F.isnan("value"), F.lit(False))
    blocks = _blocks(pixels, size, cell_of, F.sum(F.when(ok, F.col("value"))).alias("sum"), F.count_if(ok).alias("n"))
    cells = blocks.groupBy("tile", "cell").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.sum("_pixels").alias("pixels")).where((F.col("n") > 0) & (F.col("n") >= least * F.col("pixels")))
    mean = F.col("sum") / F.col("n")
    return cells.select("tile", "cell", "n", (F.log1p(mean) if log else mean).alias("value"))


def cell_excess(pixels: DataFrame, good: Column, cell_of: CellOf, size: int = 16, least: float = 0.2, background: float = 0.1, log: bool = True) -> DataFrame:
    """(tile, cell, n, seconds, value): what the mean of a cell's good pixels has over its own low quantile.

    seconds: mean of the pixels' hours of the day. The quantile interpolates between pixels. A
    block carries its good pixels, size * size at most; a cell of one tile is a bounded area."""
    ok = F.coalesce(good & (F.col("value") >= 0) & ~F.isnan("value") & ~F.isnan("hours"), F.lit(False))
    blocks = _blocks(pixels, size, cell_of, F.collect_list(F.when(ok, F.struct("value", "hours"))).alias("kept"))
    each = blocks.select("tile", "cell", "_pixels", F.posexplode_outer("kept").alias("i", "p"))
    pixels_of = F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("_pixels")))  # once a block
    cells = each.groupBy("tile", "cell").agg(F.count("p").alias("n"), pixels_of.alias("pixels"), F.avg("p.value").alias("mean"), F.percentile("p.value", F.lit(background)).alias("low"), F.avg("p.hours").alias("hours"))
    excess = F.greatest(F.col("mean") - F.col("low"), F.lit(0.0))
    seen = cells.where((F.col("n") > 0) & (F.col("n") >= least * F.col("pixels")))
    return seen.select("tile", "cell", "n", F.rint(F.col("hours") * 3600).cast("long").alias("seconds"), (F.log1p(excess) if log else excess).alias("value"))
