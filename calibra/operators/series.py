"""Order-dependent operators on series, as window functions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["stream_id", "cell"]


def cusum(rows: DataFrame, evidence: Column, drift: float = 2.0, order: tuple[str, ...] = ("bin_start",), by: list[str] = SERIES) -> DataFrame:
    """s = max(0, s before + evidence - drift) along each series: the running sum less its least value so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_p", F.sum(evidence - drift).over(w))
    return summed.withColumn("s", F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(w))).drop("_p")


def silence_runs(slots: DataFrame, p: Column, order: str = "slot", by: list[str] = SERIES) -> DataFrame:
    """1 - product of (1 - p) over the current run of silent slots; 0 where a slot reported.

    slots has a boolean column reported."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = slots.withColumn("_run", F.sum(F.col("reported").cast("int")).over(w))
    v = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_silent = F.sum(F.when(F.col("reported"), 0.0).otherwise(F.log1p(-p))).over(v)
    return runs.withColumn("presence_q", F.when(F.col("reported"), 0.0).otherwise(1 - F.exp(log_silent))).drop("_run")


def ewma_at_end(rows: DataFrame, value: str, by: list[str], order: str, rate: float = 0.05, start: float = 0.5) -> DataFrame:
    """Exponential average after the last row of each group, in order.

    The k-th row from the end has the weight rate * (1 - rate)^k. Rows whose weight is below
    the precision of a double can't change the sum, so only the last ones of a group are
    ranked, which Spark limits before it shuffles; the number of rows is counted apart."""
    reach = math.ceil(math.log(1e-20) / math.log(1 - rate))
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) - 1
    sums = rows.withColumn("_back", back).where(F.col("_back") < reach).groupBy(*by).agg(F.sum(F.col(value) * rate * F.pow(F.lit(1 - rate), "_back")).alias("_sum"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return sums.join(counts, by).select(*by, (F.col("_sum") + start * F.pow(F.lit(1 - rate), "n")).alias("p"), "n")


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top(rows, by, order, 1)


def top(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits the groups before it shuffles them."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def quota(members: DataFrame, group: str = "region", per: int = 3) -> DataFrame:
    """At most per members of a stream in a region, the most evident first; silences (infinite evidence) lead."""
    return top(members, [group, "stream_id"], [F.desc_nulls_last("s"), F.asc("cell")], per)


def newest_first(rows: DataFrame, n: int, *order: Column, back: list[Column]) -> DataFrame:
    """The newest n rows, returned oldest first."""
    return rows.orderBy(*order).limit(n).orderBy(*back)


def counter_deltas(samples: DataFrame, counters: list[str], by: list[str], order: str = "ts") -> DataFrame:
    """Growth of counters since the sample before; a smaller value is a restart and counts whole."""
    w = Window.partitionBy(*by).orderBy(order)
    out = samples
    for c in counters:
        before = F.lag(c).over(w)
        out = out.withColumn(f"d_{c}", F.when(before.isNull(), None).when(F.col(c) >= before, F.col(c) - before).otherwise(F.col(c)))
    return out


def spread_in_batch(rows: DataFrame, by: list[str], order: list[str], end: str, window: int) -> DataFrame:
    """Times dealt evenly over a batch's window in the order of the rows of a cell."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("ts", F.col(end) - window + F.floor(i * window / n).cast("long"))


def rank_offset(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The k-th row of a key is moved k seconds on; rows beyond the span are dropped."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("_k", k).where(F.col("_k") < most).withColumn("ts", F.col("ts") + F.col("_k")).drop("_k")


def lowest_site(rows: DataFrame, site: str, cell: str = "cell") -> DataFrame:
    """Rows of the lexically lowest site of each cell."""
    return rows.withColumn("_low", F.min(site).over(Window.partitionBy(cell))).where(F.col(site) == F.col("_low")).drop("_low")


def skip_newest(rows: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Rows older than the newest time of their payload, whose period may still be open."""
    return rows.withColumn("_last", F.max(ts).over(Window.partitionBy(*by))).where(F.col(ts) < F.col("_last")).drop("_last")


def throttle(rows: DataFrame, by: list[str], every: int, delta: float) -> DataFrame:
    """Rows that come every seconds after the last emitted one or differ from it by delta or more.

    What is emitted depends on what was emitted before: a task walks its series one after the
    other in the order of time and holds the last emitted row only, so a series may have any
    length. Rows without a value are left out; rows of one time come in the order of values."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = last = value = None
        for part in parts:
            keep = []
            for *own, ts, y in part[[*by, "ts", "value"]].itertuples(index=False):
                passed = own != key or ts - last >= every or abs(y - value) >= delta
                keep.append(passed)
                if passed:
                    key, last, value = own, ts, y
            yield part[keep]

    sorted_ = rows.select(*by, F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value")).where("value is not null").repartition(*by).sortWithinPartitions(*by, "ts", "value")
    return sorted_.mapInPandas(run, sorted_.schema)
