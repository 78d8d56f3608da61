"""Time bins whose width doubles with age, and other integer time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: seconds of the finest bin.
FINEST = 300


def epoch(ts: Column | str) -> Column:
    """Whole UTC seconds of a timestamp without time zone, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def bin_width(scale: Column) -> Column:
    """Seconds of a bin of a scale."""
    return F.lit(FINEST).cast("long") * F.pow(F.lit(2.0), scale).cast("long")


def scale_for_age(age: Column) -> Column:
    """Scale of an observation of an age in seconds; null for a negative age."""
    whole = F.floor(age / FINEST).cast("long") + 1
    return F.when(age >= 0, F.length(F.bin(whole)) - 1).cast("int")


def floor_to(ts: Column, width: Column | int) -> Column:
    """Largest multiple of width that isn't above ts."""
    return ts - F.pmod(ts, F.lit(width) if isinstance(width, int) else width)


def bin_start(ts: Column, scale: Column) -> Column:
    return floor_to(ts, bin_width(scale))


def scale_ages(scale: Column) -> tuple[Column, Column]:
    """Ages from (inclusive) and to (exclusive) of a scale."""
    return bin_width(scale) - FINEST, bin_width(scale + 1) - FINEST


def scales_overlapping(youngest: Column, oldest: Column, most: int = 40) -> Column:
    """Scales whose ages meet [youngest, oldest]."""
    return F.filter(F.sequence(F.lit(0), F.lit(most)), lambda s: (scale_ages(s)[0] <= oldest) & (scale_ages(s)[1] > youngest))


def row_width(flavor: Column, native: Column, cadence: Column) -> Column:
    """Seconds of a native row: none for point streams, else the configured or cadence width."""
    return F.when(flavor == "continuous", 0).otherwise(F.coalesce(native, F.greatest(F.lit(FINEST), cadence))).cast("long")


def hour_of_day(ts: Column) -> Column:
    return F.pmod(F.floor(ts / 3600), F.lit(24)).cast("int")


def day_of_week(ts: Column) -> Column:
    """0 for the first day of the week; 1970-01-01 is 4."""
    return F.pmod(F.floor(ts / 86400) + 4, F.lit(7)).cast("int")
