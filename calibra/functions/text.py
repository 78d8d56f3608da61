"""Words for people: headlines, links, templates, numbers and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    """Host of a URL without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def valid_link(url: Column) -> Column:
    """The URL if it is http or https, else null."""
    return F.when(url.rlike(r"^https?://"), url)


def headline(url: Column) -> Column:
    """Title guessed from the longest path segment of three words or more; null without one."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    words = F.transform(
        F.split(path, "/"),
        lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", ""), r"[-_+]+", " "), r"\b[0-9]{4,}\b", "")),
    )
    long_ = F.filter(words, lambda s: F.size(F.split(s, r"\s+")) >= 3)
    best = F.element_at(F.array_sort(F.transform(long_, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), 1)["s"]
    return F.when(F.size(long_) > 0, F.substring(F.concat(F.upper(F.substring(best, 1, 1)), F.substring(best, 2, 400)), 1, 160))


def tenths(x: Column) -> Column:
    """A double rounded to tenths by its exact value, ties to even (format_string rounds the shortest decimal up)."""
    high = F.lit(134217729.0) * x - (F.lit(134217729.0) * x - x)
    ten = x * 10
    error = (high * 10 - ten) + (x - high) * 10  # what the product lost
    down = F.floor(ten)
    part = ten - down
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(down, F.lit(2)) == 1))))
    return (down + F.when(up, 1).otherwise(0)) / 10


def fmt_number(v: Column, digits: int = 0) -> Column:
    """Millions with one decimal and an M, else thousands separators."""
    return F.when(F.abs(v) >= 1e6, F.concat(F.format_string("%.1f", tenths(v / 1e6)), F.lit("M"))).otherwise(F.format_string(f"%,.{digits}f", v))


def fmt_lat_lon(lat: Column, lon: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.abs(lat)), F.when(lat >= 0, "N").otherwise("S"), F.lit(" "), F.format_string("%.1f", F.abs(lon)), F.when(lon >= 0, "E").otherwise("W"))


def template(pieces: list[tuple[str, list[Column]]]) -> Column:
    """Pieces (format, fields) that have all their fields, squeezed and stripped of loose punctuation."""
    parts = [F.when(F.forall(F.array(*[c.isNotNull() for c in fields]) if fields else F.array(F.lit(True)), lambda x: x), F.format_string(fmt, *fields) if fields else F.lit(fmt)) for fmt, fields in pieces]
    return F.regexp_replace(F.regexp_replace(F.concat_ws("", *parts), r"\s+", " "), r"^[ ,:-]+|[ ,:-]+$", "")


def fill_link(template_: str, fields: dict[str, Column]) -> Column:
    """A link template with URL-encoded fields; null if a field is null."""
    out: list[Column] = []
    rest = template_
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.url_encode(fields[name].cast("string"))]
    return F.concat(*out, F.lit(rest))


def short_text(s: Column, most: int = 400) -> Column:
    """A scalar field for people: trimmed, cut, without a leading at sign."""
    return F.regexp_replace(F.substring(F.trim(s), 1, most), "^@", "")


def ascii_fold(s: Column) -> Column:
    """Letters without their marks; other characters outside ASCII are dropped."""
    marked = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝµ"
    plain = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYu"
    return F.regexp_replace(F.translate(s, marked, plain), r"[^\x00-\x7F]", "")


def redacted(s: Column, secret: str) -> Column:
    return F.replace(s, F.lit(secret), F.lit("***")) if secret else s


def names_with_rest(names: Column, most: int) -> Column:
    """The first different names, and how many more there are."""
    different = F.array_distinct(names)
    shown = F.array_join(F.slice(different, 1, most), ", ")
    return F.when(F.size(different) > most, F.concat(shown, F.lit(" +"), (F.size(different) - most).cast("string"))).otherwise(shown)


def describe_bin(n: Column, vmax: Column, noun: str, unit: str = "") -> Column:
    """'4 quakes, max M5.1' with the noun in the singular for one."""
    head = F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(noun + "s"))
    return F.when(vmax.isNull(), head).otherwise(F.concat(head, F.lit(f", max {unit}"), F.format_string("%.1f", vmax)))
