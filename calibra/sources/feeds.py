"""Parsers of particular feeds, as expressions over landed documents.

Each takes payloads (body, and url or received_at or cc where a format needs them) and gives
stream_id, cell, ts, value. cell_of maps latitude and longitude to a cell; countries is the
small dimension (cc, name, cell). A field that can't be read makes its record no observation,
a document that doesn't parse gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.geo import fixed_grid
from calibra.functions.keys import stable_offset
from calibra.functions.times import day_of_month_near, once, parse_time
from calibra.operators.sizes import small
from calibra.sources.payloads import at, json_fields, json_records, single

CellOf = Callable[[Column, Column], Column]
Parser = Callable[..., DataFrame]
PARSERS: dict[str, Parser] = {}

# Order of outage signals, levels of disasters, tsunami bulletins and severities.
SIGNALS = {"bgp": 0, "ping-slash24": 1, "merit-nt": 2, "gtr": 3}
DISASTER_LEVELS = {"Green": 0, "Orange": 1, "Red": 2}
BULLETIN_LEVELS = {"information": 0, "threat": 1, "advisory": 1, "watch": 2, "warning": 3}
#: Codes of a fire mask that say fire.
FIRE_CODES = (10, 11, 12, 13, 14, 30, 31, 32, 33, 34)
SEVERITY_CODES = {"Unknown": 0, "Minor": 1, "Moderate": 2, "Severe": 3, "Extreme": 4}


def parser(name: str) -> Callable[[Parser], Parser]:
    """Register a parser under the name of its format."""

    def put(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return put


def parse(name: str, payloads: DataFrame, **options) -> DataFrame:
    """Observations of payloads in a named format; an unknown name is an error."""
    if name not in PARSERS:
        raise KeyError(f"no parser for format {name!r}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[name](payloads, **options)


def number(text: Column) -> Column:
    """A finite number of a text, else null."""
    return once(text.try_cast("double"), lambda n: F.when(F.abs(n) < float("inf"), n))


def moment(text: Column) -> Column:
    """Seconds of an ISO time, or of an epoch in seconds or milliseconds."""
    return once(text, lambda t: F.when(t.rlike(r"^-?\d+(\.\d+)?$"), parse_time(t, "epoch")).otherwise(parse_time(t, "iso")))


def code_of(text: Column, codes: dict[str, int], other: int | None) -> Column:
    """The code of a name; other where there is none."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), F.lit(other))


def transformed(value: Column, how: str | None) -> Column:
    """value, its log (of at least 1e-12) or log1p (of at least 0)."""
    if how not in ("log", "log1p"):
        return value
    shaped = F.ln(F.greatest(value, F.lit(1e-12))) if how == "log" else F.log1p(F.greatest(value, F.lit(0.0)))
    return F.when(value.isNotNull(), shaped)


def centroid(geometry: str) -> tuple[Column, Column]:
    """(longitude, latitude) of a GeoJSON geometry: a point, or the mean vertex of the first ring."""
    kind = F.get_json_object("record", f"{geometry}.type")
    ring_at = lambda steps: F.from_json(F.get_json_object("record", f"{geometry}.coordinates{steps}"), "array<array<double>>")
    point = F.from_json(F.get_json_object("record", f"{geometry}.coordinates"), "array<double>")
    ring = F.when(kind == "Polygon", ring_at("[0]")).when(kind == "MultiPolygon", ring_at("[0][0]"))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(i))) / F.size(ring)
    return tuple(F.when(kind == "Point", F.get(point, F.lit(i))).otherwise(F.when(F.size(ring) > 0, mean(i))) for i in (0, 1))


def observed(rows: DataFrame, stream: str, event: bool = False) -> DataFrame:
    """The columns of an observation, of rows with a cell and a time (and a value, unless events)."""
    kept = single(rows.select("cell", "ts", "value")).where("cell is not null and ts is not null" + ("" if event else " and value is not null"))
    return kept.select(F.lit(stream).alias("stream_id"), "cell", F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"))


@parser("geojson_events")
def geojson_events(payloads: DataFrame, stream: str, cell_of: CellOf, times: tuple[str, ...] = ("onset", "effective", "sent"), value: str | None = None, where: dict[str, list[str]] | None = None, transform: str | None = None, id_field: str | None = None, site: str | None = None) -> DataFrame:
    """Features with a point, polygon or multipolygon, at the first time field they have.

    Items with an id are moved by up to ten minutes, so that those of one onset stay apart; a
    site field keeps the lowest site of each cell."""
    rows = json_records(payloads, "features")
    prop = lambda f: at(f"properties.{f}")
    for field, allowed in (where or {}).items():
        rows = rows.where(prop(field).isin(allowed))
    lon, lat = centroid("$.geometry")
    ts = moment(F.coalesce(*map(prop, times)))
    if id_field:
        ts = ts + F.when(F.coalesce(prop(id_field), F.lit("")) != "", stable_offset(prop(id_field), 600, 6)).otherwise(0)
    v = number(prop(value)) if value else F.lit(None).cast("double")
    v = F.when(v.isNotNull(), F.ln(F.greatest(v, F.lit(1e-9)))) if transform == "log" else transformed(v, transform)
    rows = rows.select(F.when(lon.isNotNull() & lat.isNotNull(), cell_of(lat, lon)).alias("cell"), ts.alias("ts"), v.alias("value"), (prop(site) if site else F.lit(None).cast("string")).alias("site"))
    if site:
        rows = rows.where("cell is not null and ts is not null").withColumn("low", F.min("site").over(Window.partitionBy("cell"))).where("site <=> low")
    return observed(rows, stream, event=True)


@parser("ticker")
def ticker(payloads: DataFrame, stream: str, cell: str, product: str, transform: str | None = None) -> DataFrame:
    """Price messages of one product; messages of other types and products are dropped."""
    mine = payloads.where((at("type", "body") == "ticker") & (at("product_id", "body") == product))
    ts = F.coalesce(moment(at("time", "body")), F.col("received_at").cast("long"))
    return observed(mine.select(F.lit(cell).alias("cell"), ts.alias("ts"), transformed(number(at("price", "body")), transform).alias("value")), stream)


@parser("spot")
def spot(payloads: DataFrame, stream: str, cell: str, path: str, transform: str | None = None) -> DataFrame:
    """One number of a document, at the time it was received."""
    return observed(payloads.select(F.lit(cell).alias("cell"), F.col("received_at").alias("ts"), transformed(number(at(path, "body")), transform).alias("value")), stream)


@parser("measurements")
def measurements(payloads: DataFrame, stream: str, cell_of: CellOf, path: str = "", value: str = "value") -> DataFrame:
    """Records with latitude, longitude, captured_at and a value; incomplete ones are dropped."""
    lat, lon = number(at("latitude")), number(at("longitude"))
    rows = json_records(payloads, path).select(F.when(lat.isNotNull() & lon.isNotNull(), cell_of(lat, lon)).alias("cell"), moment(at("captured_at")).alias("ts"), number(at(value)).alias("value"))
    return observed(rows, stream)


@parser("hourly_views")
def hourly_views(payloads: DataFrame, stream: str, cell: str, transform: str | None = None) -> DataFrame:
    """items with views and a stamp yyyyMMddHH; a stamp without hours is midnight."""
    stamp = F.rpad(F.substring(at("timestamp"), 1, 10), 10, "0")
    rows = json_records(payloads, "items").select(F.lit(cell).alias("cell"), parse_time(stamp, "yyyyMMddHH").alias("ts"), transformed(number(at("views")), transform).alias("value"))
    return observed(rows, stream)


@parser("box_means")
def box_means(payloads: DataFrame, stream: str, boxes: DataFrame, scale: float = 1e6, least_valid: float = 0.2, transform: str | None = None, overpass_hour: float = 13.5, end_hour: float = 19.0) -> DataFrame:
    """Daily means of boxes (box, west, east, cell), at the overpass of the day.

    A day counts if enough of its samples are valid. The day's window begins at end_hour local
    time the evening before; boxes are configuration."""
    entry = json_fields(payloads.select("body"), "body", status="status", box="box", data="data").where("status = '200'").drop("status")
    stats = "outputs.gas.bands.B0.stats."
    days = json_fields(entry, "data", error="error", samples=stats + "sampleCount", gaps=stats + "noDataCount", mean=stats + "mean", begin="interval.from")
    total, missing = F.coalesce(number(F.col("samples")), F.lit(0.0)), F.coalesce(number(F.col("gaps")), F.lit(0.0))
    lon = (F.col("west") + F.col("east")) / 2
    window = F.bround(((end_hour - 24.0) * 3600 - lon * 240) / 60).cast("long") * 60
    to_overpass = F.bround(overpass_hour * 3600 - lon * 240).cast("long") - window
    rows = days.where(F.col("error").isNull() & (total > 0) & ((total - missing) / total >= least_valid)).join(small(boxes.select("box", "west", "east", "cell")), "box")
    return observed(rows.select("cell", (moment(F.col("begin")) + to_overpass).alias("ts"), transformed(number(F.col("mean")) * scale, transform).alias("value")), stream)


@parser("fire_pixels")
def fire_pixels(pixels: DataFrame, stream: str, cell_of: CellOf, least_confidence: float = 0.5, most: int = 60) -> DataFrame:
    """Decoded pixels (ord, slot, lat, lon, frp, confidence, minute) of a fire list; missing numbers are NaN or null.

    Fires of one cell and minute are a second apart in their order; beyond a minute's seconds
    the count of a cell is saturated and they are left out."""
    good = pixels.where(~F.isnan("lat") & ~F.isnan("lon") & (F.nanvl("confidence", F.lit(-1.0)) >= least_confidence))
    minute = F.coalesce(F.nanvl("minute", F.lit(0.0)), F.lit(0.0)).cast("int")
    rows = good.select("ord", cell_of(F.col("lat"), F.col("lon")).alias("cell"), (F.col("slot") + 60 * minute).alias("base"), F.when(F.nanvl("frp", F.lit(-1.0)) >= 0, F.col("frp")).otherwise(0.0).alias("value"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cell", "base").orderBy("ord")) - 1).where(F.col("k") < most)
    return observed(rows.withColumn("ts", F.col("base") + F.col("k")), stream)


@parser("scan_fires")
def scan_fires(pixels: DataFrame, stream: str, cell_of: CellOf, lon0: float, codes: tuple[int, ...] = FIRE_CODES) -> DataFrame:
    """Pixels (ord, x, y, mask, power, start, end) of a geostationary scan whose mask says fire, placed by their scan angles.

    The fires of a cell are a second apart in their order, as far as the scan's span goes; power
    that is missing or negative is 0; pixels off the disc are left out."""
    seen = pixels.where(F.col("mask").isin(*codes)).withColumn("at", fixed_grid(F.col("x"), F.col("y"), lon0)).where("at is not null")
    power = F.when(F.nanvl("power", F.lit(-1.0)) >= 0, F.col("power")).otherwise(0.0)
    rows = seen.select("ord", "start", "end", cell_of(F.col("at.lat"), F.col("at.lon")).alias("cell"), power.alias("value"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cell", "start").orderBy("ord")) - 1).where(F.col("k") < F.greatest(F.col("end") - F.col("start"), F.lit(1)))
    return observed(rows.withColumn("ts", F.col("start") + F.col("k")), stream)


@parser("article_export")
def article_export(lines: DataFrame, stream: str, cell_of: CellOf, lat: int = 56, lon: int = 57, url: int = 60, mentions: int = 31, window: int = 900) -> DataFrame:
    """Tab-separated coded events (batch_end, line): one event a cell and article, spread over the batch's window.

    Of the codings of an article the most mentioned stands for it, then the one with the lowest id."""
    f = F.split("line", "\t")
    get = lambda i: F.trim(F.get(f, F.lit(i)))
    rows = lines.select("batch_end", get(0).try_cast("long").alias("event"), number(get(lat)).alias("lat"), number(get(lon)).alias("lon"), F.coalesce(get(url), F.lit("")).alias("url"), F.coalesce(get(mentions).try_cast("int"), F.lit(0)).alias("mentions"))
    rows = rows.where("event is not null and lat between -90 and 90 and lon between -180 and 180").withColumn("cell", cell_of(F.col("lat"), F.col("lon")))
    article = F.when(F.col("url") != "", F.col("url")).otherwise(F.col("event").cast("string"))
    best = rows.groupBy("batch_end", "cell", article.alias("article")).agg(F.max_by("event", F.struct("mentions", -F.col("event"))).alias("event"))
    by_cell = Window.partitionBy("batch_end", "cell")
    i, n = F.row_number().over(by_cell.orderBy("event")) - 1, F.count("*").over(by_cell)
    return observed(best.select("cell", (F.col("batch_end") - window + F.floor(i * window / n)).alias("ts"), F.lit(None).alias("value")), stream, event=True)


@parser("quake_messages")
def quake_messages(payloads: DataFrame, stream: str, cell_of: CellOf, least: float | None = None) -> DataFrame:
    """One quake a message; a quake without magnitude passes the least."""
    prop = lambda p: at(f"data.properties.{p}", "body")
    lat, lon, mag = number(prop("lat")), number(prop("lon")), number(prop("mag"))
    rows = payloads.select(F.when(lat.isNotNull() & lon.isNotNull(), cell_of(lat, lon)).alias("cell"), moment(prop("time")).alias("ts"), mag.alias("value"))
    return observed(rows if least is None else rows.where(F.col("value").isNull() | (F.col("value") >= least)), stream, event=True)


@parser("outage_events")
def outage_events(payloads: DataFrame, stream: str, countries: DataFrame, least: float | None = None) -> DataFrame:
    """Outages of countries: signals that start together stay apart by their order."""
    rows = json_records(payloads, "data").where(at("location").startswith("country/"))
    rows = rows.select(F.regexp_extract(at("location"), "^country/(.*)$", 1).alias("cc"), (F.floor(number(at("start"))) + code_of(at("datasource"), SIGNALS, 9)).alias("ts"), number(at("score")).alias("value"))
    if least is not None:
        rows = rows.where(F.col("value") >= least)
    return observed(rows.join(countries.select("cc", "cell"), "cc"), stream, event=True)


@parser("outage_alerts")
def outage_alerts(payloads: DataFrame, stream: str, countries: DataFrame) -> DataFrame:
    """Alerts of single signals in a country, as events without a value."""
    rows = json_records(payloads, "data").where(at("entity.type") == "country")
    rows = rows.select(at("entity.code").alias("cc"), (F.floor(number(at("time"))) + code_of(at("datasource"), SIGNALS, 9)).alias("ts"), F.lit(None).alias("value"))
    return observed(rows.join(countries.select("cc", "cell"), "cc"), stream, event=True)


_ENTRY = "entry array<struct<id:string,title:string,updated:string,identifier:string,severity:string,onset:string,sent:string,lat:string,long:string,summary:string>>"


def _entries(payloads: DataFrame, *columns: str) -> DataFrame:
    """One row for each entry of Atom feeds; prefixes of names are ignored."""
    doc = payloads.select(*columns, F.from_xml("body", _ENTRY, {"rowTag": "feed", "ignoreNamespace": "true"}).alias("feed"))
    return doc.select(*columns, F.explode("feed.entry").alias("e"))


@parser("country_warnings")
def country_warnings(payloads: DataFrame, stream: str, countries: DataFrame, severities: tuple[str, ...] = ("Severe", "Extreme")) -> DataFrame:
    """Alerts in the Atom feed of a country (cc), at their onset and a stable offset of less than ten minutes."""
    text = lambda c: F.nullif(F.trim(F.col(f"e.{c}")), F.lit(""))
    ident = F.coalesce(text("identifier"), text("id"))
    rows = _entries(payloads, "cc").where(F.trim("e.severity").isin(*severities)).select("cc", (moment(F.coalesce(text("onset"), text("sent"))) + stable_offset(ident, 600, 6)).alias("ts"), F.lit(None).alias("value"))
    return observed(rows.join(countries.select("cc", "cell"), "cc"), stream, event=True)


@parser("disasters")
def disasters(payloads: DataFrame, stream: str, cell_of: CellOf) -> DataFrame:
    """Current disasters; the alert level moves the time, so that a higher level is a new event."""
    lon, lat = centroid("$.geometry")
    rows = json_records(payloads, "features").where(F.lower(at("properties.iscurrent")) == "true")
    ts = parse_time(F.concat(at("properties.fromdate"), F.lit("Z")), "iso") + code_of(at("properties.alertlevel"), DISASTER_LEVELS, 0)
    return observed(rows.select(F.when(lon.isNotNull() & lat.isNotNull(), cell_of(lat, lon)).alias("cell"), ts.alias("ts"), F.lit(None).alias("value")), stream, event=True)


@parser("storm_texts")
def storm_texts(payloads: DataFrame, stream: str, cell_of: CellOf, now: int) -> DataFrame:
    """Warnings in free text: position, greatest wind in knots, and a day and time of this or the last month."""
    pos = r"(\d{2})(\d{4})Z\s+---\s+NEAR\s+(\d+(?:\.\d+)?)([NS])\s+(\d+(?:\.\d+)?)([EW])"
    part = lambda i: F.regexp_extract("body", pos, i)
    sign = lambda i, minus: F.when(part(i) == minus, -1.0).otherwise(1.0)
    name = F.coalesce(F.nullif(F.initcap(F.lower(F.trim(F.regexp_extract("body", r"SUBJ/(.+?)//", 1)))), F.lit("")), F.lit("Tropical cyclone"))
    wind = F.regexp_extract("body", r"MAX SUSTAINED WINDS\s+-\s+(\d+)\s+KT", 1).try_cast("double")
    ts = day_of_month_near(part(1).try_cast("int"), part(2).try_cast("int"), now) + stable_offset(name, 60)
    rows = payloads.where(F.col("body").rlike(pos)).select(cell_of(number(part(3)) * sign(4, "S"), number(part(5)) * sign(6, "W")).alias("cell"), ts.alias("ts"), wind.alias("value"))
    return observed(rows, stream, event=True)


@parser("tsunami_bulletins")
def tsunami_bulletins(payloads: DataFrame, stream: str, cell_of: CellOf, least_level: int = 0) -> DataFrame:
    """Bulletins at their epicentre, valued by their category; without one they are information."""
    summary = F.regexp_replace(F.coalesce("e.summary", F.lit("")), "<[^>]*>", "")
    category = F.lower(F.regexp_extract(summary, r"Category:\s*([A-Za-z]+)", 1))
    lat, lon = number(F.col("e.lat")), number(F.col("e.long"))
    rows = _entries(payloads).select(F.when(lat.isNotNull() & lon.isNotNull(), cell_of(lat, lon)).alias("cell"), (parse_time(F.col("e.updated"), "iso") + stable_offset(F.coalesce("e.id", F.lit("")), 60)).alias("ts"), code_of(category, BULLETIN_LEVELS, 0).alias("value"))
    return observed(rows.where(F.col("value") >= least_level), stream)


@parser("squawks")
def squawks(payloads: DataFrame, stream: str, cell_of: CellOf, codes: tuple[str, ...] = ("7500", "7600", "7700")) -> DataFrame:
    """Aircraft with an emergency code: one event an aircraft, code and hour; the aircraft is only hashed."""
    rows = json_records(payloads.withColumn("now", F.floor(number(at("now", "body")) / 1000).cast("long")), "ac").where(F.col("now") > 0)
    lat, lon, code = number(at("lat")), number(at("lon")), at("squawk")
    ts = F.col("now") - F.col("now") % 3600 + stable_offset(F.concat_ws("|", F.coalesce(at("hex"), F.lit("None")), code), 3600)
    return observed(rows.where(code.isin(*codes)).select(F.when(lat.isNotNull() & lon.isNotNull(), cell_of(lat, lon)).alias("cell"), ts.alias("ts"), code.cast("double").alias("value")).distinct(), stream)


@parser("status_components")
def status_components(payloads: DataFrame, stream: str, countries: DataFrame, aliases: dict[str, str] | None = None, pattern: str = r"^([^,]+),\s*([^-(]+?)\s*-\s*\(", group: int = 2) -> DataFrame:
    """Components that aren't operational, in the country that their name gives, directly or by an alias."""
    rows = json_records(payloads, "components").where((F.coalesce(at("status"), F.lit("operational")) != "operational") & (F.coalesce(at("group"), F.lit("false")) != "true"))
    called = F.lower(F.trim(F.regexp_extract(at("name"), pattern, group)))
    table = F.create_map(*[F.lit(x) for k, v in (aliases or {"": ""}).items() for x in (k.lower(), v)])
    rows = rows.select(called.alias("called"), F.try_element_at(table, called).alias("alias"), (parse_time(at("updated_at"), "iso") + stable_offset(F.coalesce(at("id"), F.lit("None")), 60)).alias("ts"), F.lit(None).alias("value"))
    keys = countries.select("cell", F.explode(F.array(F.concat(F.lit("cc "), "cc"), F.concat(F.lit("name "), F.lower("name")))).alias("key"))
    key = F.when(F.col("alias").isNotNull(), F.concat(F.lit("cc "), "alias")).otherwise(F.concat(F.lit("name "), "called"))
    return observed(rows.withColumn("key", key).join(keys, "key"), stream, event=True)


_CAP = "identifier string, sent string, status string, msgType string, info array<struct<language:string,severity:string,effective:string,onset:string,area:array<struct<areaDesc:string,polygon:array<string>,circle:array<string>>>>>"


@parser("cap_alerts")
def cap_alerts(payloads: DataFrame, stream: str, cell_of: CellOf, language: str = "en", severities: tuple[str, ...] | None = None, fallback: str | None = None) -> DataFrame:
    """Alerts of the common alerting protocol: one event an alert and cell that it covers, its severity as value.

    Cells are those of the areas' mean vertices and circle centres, else the fallback cell.
    Tests and cancellations are dropped. Of several blocks that of the language, else the first, counts."""
    doc = single(payloads.select("url", F.from_xml("body", _CAP, {"rowTag": "alert", "ignoreNamespace": "true"}).alias("a"))).select("url", "a.*")
    doc = doc.where("coalesce(status, 'Actual') = 'Actual' and coalesce(msgType, 'Alert') <> 'Cancel' and size(info) > 0")
    mine = F.filter("info", lambda i: F.coalesce(i["language"], F.lit("")).startswith(language))
    one = single(doc.select(F.coalesce("identifier", "url").alias("ident"), "sent", once(mine, lambda m: F.when(F.size(m) > 0, F.get(m, F.lit(0))).otherwise(F.get("info", F.lit(0)))).alias("i")))
    pair = lambda t: F.transform(F.split(t, ","), lambda x: x.try_cast("double"))
    vertices = lambda polygon: F.filter(F.transform(F.split(F.trim(polygon), r"\s+"), pair), lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    mean = lambda ring: F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, i)) / F.size(ring))
    centres = lambda area: F.concat(
        F.transform(F.filter(F.transform(F.coalesce(area["polygon"], F.array().cast("array<string>")), vertices), lambda r: F.size(r) > 0), mean),
        F.filter(F.transform(F.coalesce(area["circle"], F.array().cast("array<string>")), lambda c: pair(F.get(F.split(F.trim(c), r"\s+"), F.lit(0)))), lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull()),
    )
    points = F.flatten(F.transform(F.coalesce(F.col("i.area"), F.array().cast("array<struct<areaDesc:string,polygon:array<string>,circle:array<string>>>")), centres))
    inside = F.filter(points, lambda p: F.get(p, F.lit(0)).between(-90, 90) & F.get(p, F.lit(1)).between(-180, 180))
    cells = F.array_distinct(F.transform(inside, lambda p: cell_of(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    if fallback:
        cells = once(cells, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(fallback))))
    severity = F.coalesce(F.trim("i.severity"), F.lit("Unknown"))
    kept = one.where(severity.isin(*severities)) if severities else one
    rows = kept.select("ident", parse_time(F.coalesce("sent", "i.effective", "i.onset"), "iso").alias("sent_at"), code_of(severity, SEVERITY_CODES, 0).alias("value"), F.explode(cells).alias("cell"))
    return observed(rows.withColumn("ts", F.col("sent_at") + stable_offset(F.concat_ws("|", "ident", "cell"), 600)), stream)
