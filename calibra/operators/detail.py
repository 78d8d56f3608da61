"""What one cell or one stream shows: bins of the look-back, peaks, stories, and when they are from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.pit import detection_q

DAY = 86400


def observed_at(bin_start: Column, width: Column, now: int) -> Column:
    """When a bin's data is from: the end of a fine bin, at most now; the start of one wider than a day."""
    return F.when(width <= DAY, F.least(bin_start + width, F.lit(now))).otherwise(bin_start)


def recent_or_newest(bins: DataFrame, since: int) -> DataFrame:
    """Bins of the look-back; of a stream without any, all of its newest start."""
    w = Window.partitionBy("stream_id")
    marked = bins.withColumns({"_new": F.max("bin_start").over(w)})
    return marked.where(F.when(F.col("_new") >= since, F.col("bin_start") >= since).otherwise(F.col("bin_start") == F.col("_new"))).drop("_new")


def cell_detail(bins: DataFrame, surprise: DataFrame, stories: DataFrame, since: int, now: int, most: int = 5) -> DataFrame:
    """(cell, stream_id, observations, latest_at, latest, peak_q, peak_at, stories) of what each cell shows in the look-back.

    Streams with bins or quantiles appear. The peak is the quantile furthest from one half, the
    first of equals; stories are the best ranked records, the newest of equals."""
    own = bins.where(F.col("bin_start") >= since).groupBy("cell", "stream_id").agg(F.sum("n").alias("observations"), F.max("bin_start").alias("latest_at"), F.max_by("vmean", F.struct("bin_start", "scale")).alias("latest"))
    q = detection_q(F.col("q_detect"), F.col("q_value"))
    rows = surprise.where((F.col("bin_start") >= since) & F.col("q_value").isNotNull()).withColumn("q", q)
    peak = rows.groupBy("cell", "stream_id").agg(F.max_by(F.struct("q", "bin_start"), F.struct(F.greatest("q", 1 - F.col("q")), -F.col("bin_start"), -F.col("q"))).alias("p"))
    ranked = F.row_number().over(Window.partitionBy("cell", "stream_id").orderBy(F.desc("rank"), F.desc("ts"), "link"))
    top = stories.where((F.col("ts") >= since) & (F.col("ts") <= now)).withColumn("_i", ranked).where(F.col("_i") <= most)
    told = top.groupBy("cell", "stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "link"))), lambda x: x["link"]).alias("stories"))
    out = own.join(peak.select("cell", "stream_id", F.col("p.q").alias("peak_q"), F.col("p.bin_start").alias("peak_at")), ["cell", "stream_id"], "full")
    return out.withColumn("observations", F.coalesce("observations", F.lit(0))).join(told, ["cell", "stream_id"], "left")


def news_in_region(alerts: DataFrame, stories: DataFrame, window: int, per_cell: int = 3, most: int = 4) -> DataFrame:
    """(alert_id, stream_id, link, mentions): stories of the cells in an alert's region before it opened.

    Both sides carry region, so cells needn't be listed; the best of each cell are ranked anew."""
    near = alerts.select("alert_id", "region", "opened_at").join(stories, "region").where((F.col("ts") >= F.col("opened_at") + 1 - window) & (F.col("ts") <= F.col("opened_at")))
    own = Window.partitionBy("alert_id", "stream_id", "cell").orderBy(F.desc("mentions"), F.desc("ts"), "link")
    all_ = Window.partitionBy("alert_id", "stream_id").orderBy(F.desc("mentions"), "cell", F.desc("ts"), "link")
    best = near.withColumn("_i", F.row_number().over(own)).where(F.col("_i") <= per_cell).withColumn("_j", F.row_number().over(all_)).where(F.col("_j") <= most)
    return best.select("alert_id", "stream_id", "link", "mentions")


def window_extremes(readings: DataFrame, asks: DataFrame) -> DataFrame:
    """(ask_id, most, mean) of the readings of an ask's series in [t0, t0 + width); an ask without any has none."""
    hit = asks.join(readings, ["stream_id", "cell"]).where((F.col("ts") >= F.col("t0")) & (F.col("ts") < F.col("t0") + F.col("width")))
    return hit.groupBy("ask_id").agg(F.max("value").alias("most"), F.avg("value").alias("mean"))


def beyond_mark(rows: DataFrame, scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows strictly after the newest scored start of their series; all rows of a series that has none."""
    marks = scored.groupBy(*by).agg(F.max("bin_start").alias("_mark"))
    return rows.join(marks, by, "left").where(F.col("_mark").isNull() | (F.col("bin_start") > F.col("_mark"))).drop("_mark")


def headline_index(evidence: Column) -> Column:
    """Index of the member that a message leads with, of an array of (issued, story, level): one that its source
    issued and that has a story, else one with a story, else one at a harm level, else the first."""
    wants = (lambda e: e["issued"] & e["story"], lambda e: e["story"], lambda e: e["level"] > 0)
    places = [F.array_position(_flags(evidence, want), F.lit(True)) for want in wants]
    return F.coalesce(*[F.nullif(p, F.lit(0).cast("long")) for p in places], F.lit(1)) - 1


def _flags(evidence: Column, want) -> Column:
    return F.transform(evidence, lambda e: F.coalesce(want(e), F.lit(False)))


def whole_windows(messages: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """(stream_id, ts, n, mean): messages of each aligned window that a link held open from its start to its end.

    messages: stream_id, received, value; links: stream_id, opened, closed (null while open).
    The window in which a link opened or broke is dropped; ts is a window's start."""
    start = F.floor(F.col("received") / width) * width
    inside = messages.withColumn("ts", start).join(links, "stream_id").where((F.col("received") >= F.col("opened")) & (F.col("ts") >= F.col("opened")) & (F.col("closed").isNull() | (F.col("ts") + width <= F.col("closed"))))
    return inside.groupBy("stream_id", F.col("ts").cast("long").alias("ts")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
