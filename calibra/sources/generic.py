"""Generic parsers: configured fields of JSON or CSV records, one observation each or one a place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.keys import stable_offset
from calibra.functions.times import parse_time
from calibra.sources.feeds import CellOf, number, parser, transformed
from calibra.sources.payloads import at

#: Names a record's place: a function of the getter of its fields.
Place = Callable[[Callable[[str], Column]], Column]


def coords(cell_of: CellOf, lat: tuple[str, ...] = ("lat",), lon: tuple[str, ...] = ("lon",), null_point: bool = False) -> Place:
    """The cell of the first numbers among fields; out of range and, unless null_point says that it is a place, 0, 0 have none."""

    def place(get) -> Column:
        y, x = F.coalesce(*[number(get(f)) for f in lat]), F.coalesce(*[number(get(f)) for f in lon])
        return F.when(y.between(-90, 90) & x.between(-180, 180) & (F.lit(null_point) | (y != 0) | (x != 0)), cell_of(y, x))

    return place


def polygon(cell_of: CellOf, name: str) -> Place:
    """The cell of the mean vertex of a list of {lat, lon} or [lon, lat] points."""

    def place(get) -> Column:
        points = F.from_json(get(name), "array<string>")
        lat = lambda p: F.coalesce(number(F.get_json_object(p, "$.lat")), number(F.get_json_object(p, "$[1]")))
        lon = lambda p: F.coalesce(number(F.get_json_object(p, "$.lon")), number(F.get_json_object(p, "$[0]")))
        good = F.filter(F.transform(points, lambda p: F.struct(lat(p).alias("lat"), lon(p).alias("lon"))), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
        mean = lambda f: F.aggregate(good, F.lit(0.0), lambda acc, p: acc + p[f]) / F.size(good)
        return F.when(F.size(good) > 0, cell_of(mean("lat"), mean("lon")))

    return place


def boxed(cell_of: CellOf, boxes: list[tuple[float, float, float, float]], lat: str = "lat", lon: str = "lon") -> Place:
    """The cell of the centre of the first configured box (south, west, north, east) that holds the point."""

    def place(get) -> Column:
        y, x, out = number(get(lat)), number(get(lon)), F.lit(None).cast("string")
        for south, west, north, east in reversed(boxes):
            out = F.when(y.between(south, north) & x.between(west, east), cell_of(F.lit((south + north) / 2), F.lit((west + east) / 2))).otherwise(out)
        return out

    return place


def keyed(cells: dict[str, str], name: str = "id") -> Place:
    """The configured cell of a record's key: named points, or countries by their code."""
    return lambda get: F.try_element_at(F.create_map(*[F.lit(x) for pair in cells.items() for x in pair]), get(name))


def fixed(cell: str) -> Place:
    return lambda get: F.lit(cell)


def named(name: str) -> Place:
    return lambda get: get(name)


@dataclass(frozen=True)
class Records:
    """What to read of a feed's records.

    columns: names of a CSV text, whose first line is skipped; else bodies are JSON with the
    records at path. time: fields joined by a blank; doc_time: a field of the document instead.
    value, value_sum, value_ratio (numerators, denominator): at most one; none is a pure event.
    where, where_min: allowed texts and least numbers of fields. skip_last: leave out a
    document's newest time. site: keep the lowest site of each cell. ids: fields whose hash
    moves the time by less than spread seconds."""

    stream: str
    place: Place
    path: str = ""
    columns: tuple[str, ...] = ()
    time: tuple[str, ...] = ("time",)
    doc_time: str | None = None
    time_format: str = "iso"
    zone_seconds: int = 0
    value: str | None = None
    value_sum: tuple[str, ...] = ()
    value_ratio: tuple[tuple[str, ...], str] | None = None
    least_denominator: float = 1.0
    where: dict[str, tuple[str, ...]] = field(default_factory=dict)
    where_min: dict[str, float] = field(default_factory=dict)
    low: float | None = None
    high: float | None = None
    transform: str | None = None
    skip_last: bool = False
    site: str | None = None
    ids: tuple[str, ...] = ()
    spread: int = 600

    def rows(self, payloads: DataFrame) -> DataFrame:
        """payloads with doc (a key of the document) and one JSON record a row.

        Two documents may hold one text, so what else is known of them (url, arrival) is part of the key."""
        docs = payloads.withColumn("doc", F.xxhash64(*sorted(payloads.columns)))
        if not self.columns:
            return docs.withColumn("record", F.explode(F.from_json(at(self.path, "body"), "array<string>")))
        lines = F.slice(F.split("body", r"\r?\n"), F.lit(2), F.greatest(F.size(F.split("body", r"\r?\n")) - 1, F.lit(0)))
        schema = ", ".join(f"`{c}` string" for c in self.columns)
        return docs.withColumn("line", F.explode(lines)).where("line <> ''").withColumn("record", F.to_json(F.from_csv("line", schema))).drop("line")

    def kept(self, rows: DataFrame) -> DataFrame:
        for name, allowed in self.where.items():
            rows = rows.where(at(name).isin(*allowed))
        for name, least in self.where_min.items():
            rows = rows.where(number(at(name)) >= least)
        return rows

    def measured(self) -> Column:
        if self.value_ratio:
            above, below = self.value_ratio
            d = number(at(below))
            total = sum((F.coalesce(number(at(f)), F.lit(0.0)) for f in above), F.lit(0.0))
            return F.when((d >= self.least_denominator) & (d > 0), total / d)
        if self.value_sum:
            parts = [number(at(f)) for f in self.value_sum]
            return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
        return number(at(self.value)) if self.value else F.lit(None).cast("double")

    def ranged(self, rows: DataFrame) -> DataFrame:
        if self.low is not None:
            rows = rows.where(F.col("value").isNull() | (F.col("value") >= self.low))
        return rows if self.high is None else rows.where(F.col("value").isNull() | (F.col("value") <= self.high))


@parser("records")
def records(payloads: DataFrame, spec: Records) -> DataFrame:
    """One observation a record; records without a readable time, place or value are left out."""
    raw = at(spec.doc_time, "body") if spec.doc_time else F.when(sum((at(f).isNull().cast("int") for f in spec.time), F.lit(0)) == 0, F.concat_ws(" ", *map(at, spec.time)))
    site = at(spec.site) if spec.site else F.lit(None).cast("string")
    offset = stable_offset(F.concat_ws("|", *[F.coalesce(at(f), F.lit("None")) for f in spec.ids]), spec.spread) if spec.ids else F.lit(0)
    rows = spec.kept(spec.rows(payloads)).select("doc", spec.place(at).alias("cell"), parse_time(raw, spec.time_format, spec.zone_seconds).alias("ts"), spec.measured().alias("value"), site.alias("site"), offset.alias("offset")).where("cell is not null and ts is not null")
    if spec.value or spec.value_sum or spec.value_ratio:
        rows = rows.where("value is not null")
    rows = spec.ranged(rows)
    if spec.skip_last:
        rows = rows.withColumn("newest", F.max("ts").over(Window.partitionBy("doc"))).where("ts < newest")
    if spec.site:
        rows = rows.withColumn("low", F.min("site").over(Window.partitionBy("doc", "cell"))).where("site <=> low")
    return rows.select(F.lit(spec.stream).alias("stream_id"), "cell", (F.col("ts") + F.col("offset")).cast("long").alias("ts"), transformed(F.col("value"), spec.transform).alias("value"))


@parser("cell_aggregate")
def cell_aggregates(payloads: DataFrame, spec: Records, how: str, least: int = 1, below: float = 0.0, distinct: str = "id", record_time: str | None = None, bucket: int = 0, zero_cells: tuple[str, ...] = ()) -> DataFrame:
    """One observation a document and place: count, median, mean, fraction (of values below a bound) or distinct.

    The time is that of the document, else the newest of its kept records, else that of its
    arrival. Places in zero_cells without a record count zero, in documents that have any."""
    value = {"count": F.lit(1.0), "distinct": at(distinct)}.get(how, spec.measured())
    doc_time = parse_time(at(spec.doc_time, "body"), spec.time_format) if spec.doc_time else F.lit(None).cast("long")
    own_time = parse_time(at(record_time), spec.time_format) if record_time else F.lit(None).cast("long")
    rows = spec.kept(spec.rows(payloads)).select("doc", F.col("received_at").cast("long").alias("received_at"), spec.place(at).alias("cell"), value.alias("value"), doc_time.alias("doc_time"), own_time.alias("own_time")).where("cell is not null")
    newest = rows.groupBy("doc").agg(F.max("own_time").alias("newest"))
    good = rows.where("value is not null")
    good = good if how in ("count", "distinct") else spec.ranged(good)
    measure = {"count": F.count("*").cast("double"), "distinct": F.count_distinct("value").cast("double"), "median": F.median("value"), "mean": F.avg("value"), "fraction": F.avg((F.col("value") < below).cast("double"))}[how]
    n = F.count_distinct("value") if how == "distinct" else F.count("*")
    groups = good.groupBy("doc", "cell", "received_at", "doc_time").agg(measure.alias("value"), n.alias("n"))
    if zero_cells:
        # a zero row for each place, taken where the document has no other
        every = groups.select("doc", "received_at", "doc_time").distinct().withColumn("cell", F.explode(F.array(*map(F.lit, zero_cells))))
        both = groups.unionByName(every.withColumns({"value": F.lit(0.0), "n": F.lit(None).cast("long")}))
        groups = both.groupBy("doc", "cell", "received_at", "doc_time").agg(F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("value"))), F.lit(0.0)).alias("value"), F.max("n").alias("n"))
    groups = groups.where(F.col("n").isNull() | (F.col("n") >= least)).join(newest, "doc")
    known = F.coalesce("doc_time", "newest")
    ts = F.coalesce(known - F.pmod(known, F.lit(bucket)) if bucket else known, F.col("received_at"))
    return groups.select(F.lit(spec.stream).alias("stream_id"), "cell", ts.cast("long").alias("ts"), transformed(F.col("value"), spec.transform).alias("value"))
