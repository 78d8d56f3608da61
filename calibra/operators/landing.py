"""Choice among landed documents: newest files, linked versions not yet fetched, pages, keys remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.sources.payloads import at


def newest_file(files: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    """Of each group of files (path) the one with the greatest stamp in its name, the last by name of equals.

    pattern's first group is the stamp; other names are passed over. A stamp is compared as text."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stamped = files.withColumn("stamp", F.regexp_extract(name, pattern, 1)).where(name.rlike(pattern) & (F.col("stamp") != ""))
    return stamped.groupBy(*by).agg(F.max("stamp").alias("stamp"), F.max_by("path", F.struct("stamp", "path")).alias("path"))


def newest_or_before(files: DataFrame, pattern: str, by: list[str], folder: str) -> DataFrame:
    """The newest matching file of each group's last folder, or of the folder before where that has none."""
    last = files.groupBy(*by).agg(F.sort_array(F.collect_set(folder), asc=False).alias("_folders"))
    near = files.join(last, by).where(F.array_contains(F.slice("_folders", 1, 2), F.col(folder)))
    return newest_file(near, pattern, [*by, folder]).groupBy(*by).agg(F.max_by(F.struct("stamp", "path"), folder).alias("f")).select(*by, "f.stamp", "f.path")


def linked_versions(listings: DataFrame, fetched: DataFrame, most: int) -> DataFrame:
    """(feed, link, version) of the items of RSS or Atom listings (feed, body) that were not fetched, at most so many a feed, in their order.

    A version is the item's guid or id, else its link, with its date; an item that a listing repeats counts once."""
    items = listings.select("feed", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)[ >](.*?)</(?:item|entry)>"), 1)).alias("i", "item"))
    part = lambda p: F.trim(F.regexp_extract("item", p, 1))
    link = F.coalesce(F.nullif(part(r"<link>([^<]*)</link>"), F.lit("")), F.nullif(part(r'<link[^>]*href="([^"]*)"'), F.lit("")))
    ident = F.coalesce(F.nullif(part(r"<(?:guid|id)[^>]*>([^<]*)<"), F.lit("")), link)
    rows = items.select("feed", "i", link.alias("link"), F.concat_ws("|", ident, part(r"<(?:pubDate|updated)>([^<]*)<")).alias("version")).where("link is not null")
    first = rows.groupBy("feed", "link", "version").agg(F.min("i").alias("i")).join(fetched.select("feed", "version").distinct(), ["feed", "version"], "left_anti")
    place = F.row_number().over(Window.partitionBy("feed").orderBy("i"))
    return first.withColumn("_n", place).where(F.col("_n") <= most).select("feed", "link", "version")


def remembered(keys: DataFrame, by: list[str], order: Column, most: int = 5_000) -> DataFrame:
    """The newest keys of each group; the oldest beyond so many are forgotten."""
    return keys.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def paged(pages: DataFrame, path: str, most_pages: int) -> DataFrame:
    """(feed, record) of the first pages (feed, page, body) of each feed, up to the first without a next link."""
    w = Window.partitionBy("feed").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(at("next", "body").isNull()).over(w), F.lit(False))
    read = pages.withColumn("_ended", ended).where(~F.col("_ended") & (F.col("page") < most_pages))
    return read.select("feed", F.explode(F.from_json(at(path, "body"), "array<string>")).alias("record"))


def readable(targets: DataFrame) -> DataFrame:
    """(batch, target, body) of the targets of a poll that answered; a poll in which all failed is kept as failed, with null bodies."""
    ok = (F.col("status") == 200) & F.col("body").isNotNull()
    w = Window.partitionBy("batch")
    return targets.withColumns({"_ok": ok, "_any": F.max(ok).over(w)}).where("_ok or not _any").select("batch", "target", F.when(F.col("_ok"), F.col("body")).alias("body"))


def health_rows(events: DataFrame) -> DataFrame:
    """One row a (component, ts, event): a repeat in the same second is ignored, the least detail stays."""
    return events.groupBy("component", "ts", "event").agg(F.min("detail").alias("detail"))


def total_size(records: DataFrame) -> DataFrame:
    """Bytes of all records; 0 for none."""
    return records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
