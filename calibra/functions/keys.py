"""Hashes that must stay the same for ever: offsets, seeds and jitter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_offset(key: Column, spread: int, digits: int = 8) -> Column:
    """Number below spread from the first hex digits of a key's SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("binary")), 1, digits), 16, 10).cast("long"), F.lit(spread))


def cell_seed(stream: Column, cell: Column) -> Column:
    """CRC-32 of 'stream|cell'."""
    return F.crc32(F.concat_ws("|", stream, cell).cast("binary"))


def jitter(stream: Column, cadence: Column) -> Column:
    """Seconds by which a poll is shifted: a 32-bit polynomial hash (base 131) over a tenth of the cadence."""
    h = F.aggregate(F.split(stream, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise((acc * 131 + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("long"))))
    return F.pmod(h, F.greatest(F.floor(cadence / 10), F.lit(1))).cast("long")
