"""Quantiles under a series' own prediction, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least tail probability and the words of rarity.
LEAST_P = 1e-300
UNUSUAL, RARE = 0.9, 0.99


def detection_q(q_detect: Column, q: Column) -> Column:
    """The quantile that tail decisions read: q_detect only where it differs from q."""
    return F.coalesce(q_detect, q)


def conservative_q(q_lo: Column, q_hi: Column) -> Column:
    """The value of [q_lo, q_hi] closest to one half."""
    return F.when(q_lo > 0.5, q_lo).when(q_hi < 0.5, q_hi).otherwise(0.5)


def tail_p(q: Column, tail: Column) -> Column:
    """Tail probability on the side that matters, within [1e-300, 1]."""
    p = F.when(tail == "upper", 1 - q).when(tail == "lower", q).otherwise(2 * F.least(q, 1 - q))
    return F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1.0))


def surprisal(q: Column, tail: Column) -> Column:
    return -F.ln(tail_p(q, tail))


def tail_extremity(q: Column, tail: Column) -> Column:
    """How far out a quantile lies, from 0.5 to 1."""
    return F.when(tail == "upper", F.greatest(q, F.lit(0.5))).when(tail == "lower", F.greatest(1 - q, F.lit(0.5))).otherwise(F.greatest(q, 1 - q))


def row_extremity(q: Column, presence_q: Column, tail: Column) -> Column:
    """Extremity of a row: of its quantile, or of its silence where it has none."""
    return F.coalesce(tail_extremity(q, tail), presence_q)


def decile(q: Column) -> Column:
    """Histogram cell 0-9; q = 1 falls in the last, a negative q in the first."""
    return F.greatest(F.least(F.floor(q * 10), F.lit(9)), F.lit(0)).cast("int")


def rarity_word(q: Column) -> Column:
    e = F.greatest(q, 1 - q)
    return F.when(e < UNUSUAL, "typical").when(e < RARE, "unusual").otherwise("rare")


def rarity_odds(q: Column) -> Column:
    """1-in-n words of the nearer tail."""
    tail = F.least(q, 1 - q)
    side = F.when(q > 0.5, "high").otherwise("low")
    odds = F.when(tail <= 1e-6, "over 1-in-1M").otherwise(F.concat(F.lit("1-in-"), F.round(1 / tail).cast("long").cast("string")))
    return F.concat(odds, F.lit(" "), side)


def transform(v: Column, how: str | None) -> Column:
    """log (of at least 1e-12), log1p (of at least 0) or the value itself; null stays null."""
    if how not in ("log", "log1p"):
        return v
    return F.when(v.isNotNull(), F.ln(F.greatest(v, F.lit(1e-12))) if how == "log" else F.log1p(F.greatest(v, F.lit(0.0))))


def inverse(v: Column, how: str | None, percent: bool = False) -> Column:
    raw = F.exp(v) if how == "log" else F.expm1(v) if how == "log1p" else v
    return raw * 100 if percent else raw


def quantum_edges(raw: Column, quantum: float, how: str | None) -> tuple[Column, Column]:
    """Transformed ends of the interval that rounding to a quantum hides."""
    return transform(raw - quantum / 2, how), transform(raw + quantum / 2, how)


def scored_value(flavor: Column, n: Column, mean: Column) -> Column:
    """What a model sees of a bin: the count, or the mean of its values (null is unscorable)."""
    return F.when(flavor == "count", n.cast("double")).otherwise(mean)
