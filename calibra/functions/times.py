"""Times in feeds, as whole UTC seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibra.functions.bins import epoch


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated a single time however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_time(raw: Column, fmt: str = "iso", offset_seconds: int = 0) -> Column:
    """Seconds of a time in text; null if it can't be read.

    fmt: iso, epoch, epoch_ms, or a pattern. Whole numbers from 1e11 on are milliseconds.
    offset_seconds: zone of times that name none."""
    return once(F.lit(None).cast("string") if raw is None else raw, lambda t: _seconds(t, fmt, offset_seconds))


def _seconds(raw: Column, fmt: str, offset_seconds: int) -> Column:
    if fmt in ("epoch", "epoch_ms"):
        n = raw.try_cast("double")
        return F.when((F.lit(fmt) == "epoch_ms") | (n >= 1e11), F.floor(n / 1000)).otherwise(F.floor(n)).cast("long")
    text = raw.cast("string")
    if fmt == "iso":
        bare = F.regexp_replace(F.regexp_replace(text, r"\.\d+", ""), r"(Z|[+-]\d\d:?\d\d)$", "")
        zone = F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", 1)
        shift = F.when(zone == "", F.when(text.endswith("Z"), 0).otherwise(offset_seconds)).otherwise(
            F.when(zone == "-", -1).otherwise(1) * (F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", 2).try_cast("int") * 3600 + F.regexp_extract(text, r"([+-])(\d\d):?(\d\d)$", 3).try_cast("int") * 60)
        )
        shift = F.when(text.rlike(r"\d[T ]\d"), shift).otherwise(offset_seconds)
        return epoch(F.replace(bare, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")) - shift
    return epoch(F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")) - offset_seconds


def stamp(ts: Column) -> Column:
    """ISO text with a Z."""
    return F.concat(F.replace(F.substring(F.timestamp_add("SECOND", ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def day_of_month_near(day: Column, hour_minute: Column, now: int) -> Column:
    """Seconds of a 'day of month, HHMM' time: the latest such time at most a day after now."""
    base = F.lit(now).cast("long")
    first = F.trunc(F.timestamp_add("SECOND", base, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "month")
    at = lambda month: epoch(F.date_add(month, day - 1).cast("timestamp_ntz")) + F.floor(hour_minute / 100) * 3600 + hour_minute % 100 * 60
    this, before = at(first), at(F.add_months(first, -1))
    return F.when(this <= base + 86400, this).otherwise(before)
