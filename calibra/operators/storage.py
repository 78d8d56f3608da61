"""Upserts, retention, and incremental export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """new over old; columns in keep hold their old value where there is one."""
    o = old.select(*key, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_old"))
    joined = new.join(o, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return joined.unionByName(old.join(new.select(*key), key, "left_anti").select(*new.columns))


def add_up(old: DataFrame, new: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """Counters of both, added."""
    return old.unionByName(new).groupBy(*key).agg(*[F.sum(c).alias(c) for c in counters])


def newest_version(batches: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Latest row of each key over all exported batches."""
    return batches.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_i = 1").drop("_i")


def within_budget(records: DataFrame, size: str, order: list[Column], budget: int, bucket: Column) -> DataFrame:
    """The newest records whose sizes add up to the budget.

    Sums by bucket of time come first (one narrow row a bucket: days of history); only the
    bucket in which the budget ends is ordered row by row, so no task holds all records."""
    keyed = records.withColumn("_bucket", bucket)
    sums = keyed.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    after = F.coalesce(F.sum("_sum").over(Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("_after", after)
    joined = keyed.join(ends, "_bucket").where(F.col("_after") < budget)
    whole = joined.where(F.col("_after") + F.col("_sum") <= budget)
    cut = joined.where(F.col("_after") + F.col("_sum") > budget)
    run = F.sum(size).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_after")
    return whole.unionByName(cut.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")).drop("_bucket", "_sum", "_after")


def younger(rows: DataFrame, ts: str, now: int, retention: int) -> DataFrame:
    return rows.where(F.col(ts) >= now - retention)


def export_increment(rows: DataFrame, version: str, mark: int, path: str, batch: int) -> None:
    """Write rows from the mark on as one numbered batch; running it again replaces that batch."""
    rows.where(F.col(version) >= mark).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/_batch={batch:08d}")


def export_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_once(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append to a frozen archive: those whose key it doesn't hold."""
    return rows.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def current_states(states: DataFrame, versions: DataFrame) -> DataFrame:
    """Model states whose version is the current one of their flavor; versions is configuration."""
    return states.join(versions, ["flavor", "version"], "left_semi")
