"""Queries: payload parsers, over documents that are built from the events and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.bins import epoch
from calibra.plans.registry import query
from calibra.plans.tables import obs, read, with_tables
from calibra.sources import payloads


def _documents(spark: SparkSession, sf_dir: str, record, path: str) -> DataFrame:
    """One JSON document a user and event type, with an array of records at a path."""
    e = read(spark, sf_dir, "events").withColumn("s", epoch("ts"))
    return e.groupBy("user_id", "event_type").agg(F.collect_list(record).alias(path)).select(F.to_json(F.struct(path)).alias("body"))


@query(with_tables("SELECT 'landed' AS stream_id, stream_id AS cell, ts, round(value, 6) AS value FROM obs WHERE stream_id IN ('click', 'purchase') AND value BETWEEN 10 AND 90"))
def json_record_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, F.struct(F.col("event_type").alias("kind"), F.col("s").alias("when"), F.struct("value").alias("reading")), "items")
    return payloads.records(docs, "landed", "items", "kind", ("when", "epoch"), "reading.value", {"kind": ["click", "purchase"]}, 10, 90).withColumn("value", F.round("value", 6))


@query(with_tables("SELECT 'quakes' AS stream_id, CAST(floor(event_id % 170 - 85.0) AS BIGINT) || '_' || CAST(floor(user_id % 360 - 180.0) AS BIGINT) AS cell, ts, round(value, 6) AS value FROM obs WHERE value >= 20"))
def geojson_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.array(F.col("user_id") % 360 - 180.0, F.col("event_id") % 170 - 85.0).alias("coordinates"))
    docs = _documents(spark, sf_dir, F.struct(point.alias("geometry"), F.struct((F.col("s") * 1000).alias("time"), F.col("value").alias("mag")).alias("properties")), "features")
    cell = lambda lat, lon: F.concat_ws("_", F.floor(lat).cast("string"), F.floor(lon).cast("string"))
    return payloads.geojson_points(docs, "quakes", cell, least=20).withColumn("value", F.round("value", 6))


@query("SELECT 'load' AS stream_id, 'grid' AS cell, CAST(l_orderkey * 10 + i - 1 AS BIGINT) AS ts, CAST(q AS DOUBLE) AS value FROM (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE i < n")
def parallel_series_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(line.alias("x"))
    times = F.transform("x", lambda x, i: (F.col("l_orderkey") * 10 + i).cast("string"))
    docs = rows.select(F.to_json(F.struct(F.struct(times.alias("timestamps"), F.transform("x", lambda x: x["l_quantity"].cast("string")).alias("values")).alias("serie"))).alias("body"))
    return payloads.parallel_series(docs, "load", "grid", "serie.timestamps", "serie.values", "epoch")


@query(with_tables("SELECT stream_id, cell, CAST(ts // 21600 * 21600 AS BIGINT) AS ts, round(median(value), 6) AS value FROM obs GROUP BY 1, 2, 3 HAVING count(*) >= 2"))
def cell_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.cell_aggregate(obs(spark, sf_dir), "median", 21600, 2).withColumn("value", F.round("value", 6))
