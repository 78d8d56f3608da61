"""Observations from payload files: JSON records, GeoJSON, parallel series, CAP/Atom XML, text tables.

A payload table has a row for each landed document (body, and url or received_at where a
format needs them). Parsing is done by SQL functions only, so it runs inside the scan's stage;
a document that doesn't parse gives no rows. Each function returns stream_id, cell, ts, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of emergency transponders; severities of alerts in ascending order (fixed values).
SQUAWKS = ("7500", "7600", "7700")
SEVERITIES = ("Unknown", "Minor", "Moderate", "Severe", "Extreme")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(url, received_at, body) of each file below a folder; received_at is the file's time."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("url"), F.unix_timestamp("_metadata.file_modification_time").alias("received_at"), F.col("value").alias("body"))


def _first_with(items: Column, field: str, want: str) -> Column:
    return F.get(F.filter(items, lambda x: F.get_json_object(x, f"$['{field}']") == want), F.lit(0))


def at(path: str, column: str | Column = "record") -> Column:
    """A field of a JSON text, by dotted path; names may hold any sign but quotes.

    A whole number is an index into a list; name[field=want] is the first element of a list
    whose field has that text. Null where something on the way is missing."""
    node, steps = F.col(column) if isinstance(column, str) else column, "$"
    for part in path.split(".") if path else ():
        name, _, wanted = part.removesuffix("]").partition("[") if part.endswith("]") else (part, "", "")
        steps += f"[{name}]" if name.isdigit() else f"['{name}']" if name else ""
        if wanted:
            field, _, want = wanted.partition("=")
            node, steps = _first_with(F.from_json(F.get_json_object(node, steps), "array<string>"), field, want), "$"
    return F.get_json_object(node, steps) if steps != "$" else node


def flattened(record: Column, dots: int = 3) -> Column:
    """A JSON record as a map of dotted names, lists by index; what lies deeper than so many dots stays JSON text."""

    def level(value: Column, prefix: Column, left: int) -> Column:
        named = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))

        def one(e: Column) -> Column:
            name = F.concat(prefix, e["key"])
            leaf = F.array(F.struct(name.alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
            return F.when(F.schema_of_variant(e["value"]).rlike("^(OBJECT|ARRAY)"), level(e["value"], F.concat(name, F.lit(".")), left - 1)).otherwise(leaf) if left else leaf

        return F.flatten(F.transform(F.coalesce(named, listed), one))

    return F.map_from_entries(level(F.try_parse_json(record), F.lit(""), dots))


def json_records(payloads: DataFrame, path: str = "") -> DataFrame:
    """payloads with one row for each element of the array at a path, as JSON text in record."""
    array = at(path, "body") if path else F.col("body")
    return payloads.withColumn("record", F.explode(F.from_json(array, "array<string>"))).drop("body")


def single(rows: DataFrame) -> DataFrame:
    """The same rows, computed once each: filters put on them later aren't moved below, where they would repeat the parsing."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


def json_fields(payloads: DataFrame, array: str, **paths: str) -> DataFrame:
    """One row for each element of a column's JSON array, in place of the column: each path is read once, as text."""
    fields = F.transform(F.from_json(array, "array<string>"), lambda r: F.struct(*[at(p, r).alias(name) for name, p in paths.items()]))
    return payloads.withColumn("_fields", F.explode(fields)).select(*[c for c in payloads.columns if c != array], "_fields.*")


def event_time(text: Column, fmt: str) -> Column:
    """Seconds of a time given as epoch, epoch_ms or a datetime pattern (UTC); null if malformed."""
    if fmt == "epoch":
        return F.floor(text.try_cast("double")).cast("long")
    if fmt == "epoch_ms":
        return F.floor(text.try_cast("double") / 1000).cast("long")
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(fmt)))


def records(payloads: DataFrame, stream: str, path: str, cell: str, time: tuple[str, str], value: str | None, where: dict[str, list[str]] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """One observation a record: field names by dotted path, allow-lists, and a range for the value.

    Records without a readable time or cell are left out, as are values out of range; value
    None makes a pure event, whose value is null."""
    rows = json_records(payloads, path)
    for field, allowed in (where or {}).items():
        rows = rows.where(at(field).isin(allowed))
    v = at(value).try_cast("double") if value else F.lit(None).cast("double")
    rows = rows.select(F.lit(stream).alias("stream_id"), at(cell).alias("cell"), event_time(at(time[0]), time[1]).alias("ts"), v.alias("value")).where("cell is not null and ts is not null")
    if value:
        rows = rows.where("value is not null")
    if low is not None:
        rows = rows.where(F.col("value") >= low)
    return rows.where(F.col("value") <= high) if high is not None else rows


def geojson_points(payloads: DataFrame, stream: str, cell_of, time: str = "time", value: str = "mag", least: float | None = None) -> DataFrame:
    """Point features with a time in epoch milliseconds; a feature without the value passes the least."""
    rows = json_records(payloads, "features").select(
        F.get_json_object("record", "$.geometry.coordinates[0]").try_cast("double").alias("lon"),
        F.get_json_object("record", "$.geometry.coordinates[1]").try_cast("double").alias("lat"),
        event_time(at(f"properties.{time}"), "epoch_ms").alias("ts"),
        at(f"properties.{value}").try_cast("double").alias("value"),
    ).where("lat between -90 and 90 and lon is not null and ts is not null")
    if least is not None:
        rows = rows.where(F.col("value").isNull() | (F.col("value") >= least))
    return rows.select(F.lit(stream).alias("stream_id"), cell_of(F.col("lat"), F.col("lon")).alias("cell"), "ts", "value")


def parallel_series(payloads: DataFrame, stream: str, cell: str, times: str, values: str, fmt: str) -> DataFrame:
    """Two arrays of one length, without their last point, which is still in progress.

    Arrays of different lengths are an error of the document: it gives no rows."""
    t, v = F.from_json(at(times, "body"), "array<string>"), F.from_json(at(values, "body"), "array<string>")
    rows = payloads.select(t.alias("t"), v.alias("v")).where("size(t) = size(v) and size(t) > 1")
    points = rows.select(F.explode(F.slice(F.arrays_zip("t", "v"), F.lit(1), F.size("t") - 1)).alias("p"))
    return points.select(F.lit(stream).alias("stream_id"), F.lit(cell).alias("cell"), event_time(F.col("p.t"), fmt).alias("ts"), F.col("p.v").try_cast("double").alias("value")).where("ts is not null and value is not null")


def scalar(payloads: DataFrame, stream: str, cell: str, path: str) -> DataFrame:
    """One number of a document, at the time it was received."""
    return payloads.select(F.lit(stream).alias("stream_id"), F.lit(cell).alias("cell"), F.col("received_at").cast("long").alias("ts"), at(path, "body").try_cast("double").alias("value")).where("value is not null")


def squawks(payloads: DataFrame, stream: str, cell_of) -> DataFrame:
    """Aircraft with an emergency code: one event an aircraft, code and hour; the aircraft is only hashed."""
    rows = json_records(payloads.withColumn("now", at("now", "body").try_cast("double")), "ac")
    rows = rows.select(at("squawk").alias("code"), at("hex").alias("aircraft"), at("lat").try_cast("double").alias("lat"), at("lon").try_cast("double").alias("lon"), F.floor(F.when(F.col("now") > 1e11, F.col("now") / 1000).otherwise(F.col("now"))).cast("long").alias("now"))
    rows = rows.where(F.col("code").isin(*SQUAWKS) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("now").isNotNull())
    hour = F.col("now") - F.col("now") % 3600
    offset = F.pmod(F.xxhash64("aircraft", "code"), F.lit(3600))
    return rows.select(F.lit(stream).alias("stream_id"), cell_of(F.col("lat"), F.col("lon")).alias("cell"), (hour + offset).alias("ts"), F.lit(None).cast("double").alias("value")).distinct()


def components(payloads: DataFrame, stream: str) -> DataFrame:
    """Components of a status page that aren't operational, groups left out; cell is the part of the name in brackets."""
    rows = json_records(payloads, "components").where((at("status") != "operational") & (F.coalesce(at("group"), F.lit("false")) != "true"))
    place = F.nullif(F.regexp_extract(at("name"), r"\(([^)]+)\)", 1), F.lit(""))
    return rows.select(F.lit(stream).alias("stream_id"), F.coalesce(place, at("name")).alias("cell"), F.unix_timestamp(F.try_to_timestamp(at("updated_at"))).alias("ts"), F.lit(None).cast("double").alias("value")).where("ts is not null")


_CAP = "identifier string, sent string, status string, msgType string, info array<struct<language:string,event:string,severity:string,area:array<struct<areaDesc:string>>>>"


def cap_alerts(payloads: DataFrame, stream: str, language: str = "en") -> DataFrame:
    """Alerts of the common alerting protocol: one observation an alert and area, severity as value.

    Tests and cancellations are left out; of several language blocks the preferred one, else the first, is read."""
    doc = payloads.select(F.from_xml("body", _CAP, {"rowTag": "alert"}).alias("a")).select("a.*").where("status = 'Actual' and msgType <> 'Cancel' and size(info) > 0")
    preferred = F.filter("info", lambda i: F.lower(i["language"]).startswith(language))
    one = doc.select("identifier", F.unix_timestamp(F.try_to_timestamp("sent")).alias("ts"), F.when(F.size(preferred) > 0, preferred[0]).otherwise(F.col("info")[0]).alias("i"))
    code = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("i.severity")), F.lit(0)), F.lit(1)) - 1
    return one.select(F.lit(stream).alias("stream_id"), F.explode(F.array_distinct(F.transform("i.area", lambda x: x["areaDesc"]))).alias("cell"), "ts", code.cast("double").alias("value")).where("ts is not null and cell is not null")


def project_views(payloads: DataFrame, stream: str) -> DataFrame:
    """Lines `project title views bytes`; desktop and mobile views of a language are added; the hour is that of the file's name."""
    stamp = F.regexp_extract("url", r"(\d{8}-\d{2}0000)", 1)
    rows = payloads.select(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss"))).alias("ts"), F.explode(F.split("body", "\n")).alias("line")).select("ts", F.split("line", " ").alias("f")).where("size(f) >= 3 and ts is not null")
    rows = rows.select("ts", F.regexp_replace(F.col("f")[0], r"\.m$", "").alias("cell"), F.col("f")[2].try_cast("double").alias("value")).where("value is not null")
    return rows.groupBy("ts", "cell").agg(F.sum("value").alias("value")).select(F.lit(stream).alias("stream_id"), "cell", "ts", "value")


def cell_aggregate(rows: DataFrame, how: str, bucket: int, least: int = 1, below: float | None = None) -> DataFrame:
    """One observation a place and bucket of time: count, median, mean, distinct, or fraction of values below a bound."""
    measures = {"count": F.count("*").cast("double"), "mean": F.avg("value"), "median": F.median("value"), "distinct": F.count_distinct("value").cast("double")}
    measure = F.avg((F.col("value") < below).cast("double")) if how == "fraction_below" else measures[how]
    start = (F.floor(F.col("ts") / bucket) * bucket).alias("ts")
    return rows.groupBy("stream_id", "cell", start).agg(measure.alias("value"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
