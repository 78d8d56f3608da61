"""The live path as Structured Streaming: exactly-once keys, windows by arrival, stateful scoring.

Streams of observations have stream_id, cell, ts (seconds), value and first_seen (seconds of
arrival). Batch and stream share the models' step functions.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from calibra.models import continuous, count
from calibra.operators.storage import append_once

DAY = 86400
_ROW = "stream_id string, cell string, bin_start long, q_value double, q_detect double, model_version int"


def once(stream: DataFrame, retention: str = "8 days") -> DataFrame:
    """Each (stream_id, cell, ts) once; a key is remembered for the retention after its arrival."""
    timed = stream.withColumn("arrived", F.timestamp_seconds("first_seen")).withWatermark("arrived", retention)
    return timed.dropDuplicatesWithinWatermark(["stream_id", "cell", "ts"]).drop("arrived")


def arrival_windows(stream: DataFrame, width: int, grace: int = 60) -> DataFrame:
    """Counts by window of arrival; a window is emitted once its end lies the grace back."""
    timed = stream.withColumn("arrived", F.timestamp_seconds("first_seen")).withWatermark("arrived", f"{grace} seconds")
    counts = timed.groupBy(F.window("arrived", f"{width} seconds").alias("w"), "stream_id", "cell").agg(F.count("*").alias("n"))
    return counts.select("stream_id", "cell", F.unix_timestamp("w.start").alias("win_start"), "n")


def score_points(stream: DataFrame, par: continuous.ContinuousParams = continuous.ContinuousParams()) -> DataFrame:
    """Quantiles of point values as they arrive, in the order of their time within a batch.

    A value at or before its series' last time is not scored again: its quantile is null.
    A null value is passed over."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, last = pickle.loads(state.get[0]) if state.exists else (continuous.ContinuousState(), None)
        rows = pd.concat(list(parts)).sort_values("ts")
        seed, steps, scored = zlib.crc32("|".join(key).encode()), [], []
        for ts, y in zip(rows["ts"].tolist(), rows["value"].tolist()):
            scored.append(y is not None and not np.isnan(y) and (last is None or ts > last))
            if scored[-1]:
                steps.append((ts, y))
                last = ts
        times = [ts for ts, _ in steps]
        model, found = continuous.follow(model, par, times, [y for _, y in steps])
        told = zip(*continuous.quantiles(par, times, found, seed))
        out = [(*key, ts, *(next(told) if good else (None, None)), continuous.VERSION) for ts, good in zip(rows["ts"].tolist(), scored)]
        state.update((pickle.dumps((model, last)),))
        yield pd.DataFrame(out, columns=["stream_id", "cell", "bin_start", "q_value", "q_detect", "model_version"])

    rows = stream.select("stream_id", "cell", "ts", "value").groupBy("stream_id", "cell")
    return rows.applyInPandasWithState(run, _ROW, "model binary", "append", GroupStateTimeout.NoTimeout)


def score_counts(stream: DataFrame, width: int, grace: int = 60, ttl: int = 30 * DAY, par: count.CountParams = count.CountParams()) -> DataFrame:
    """Quantiles of closed windows of arrival, quiet ones included, of each active cell.

    The state of a cell is its model, the window that it waits for and the counts of open
    windows. A window closes when the watermark passes its end; a timer wakes silent cells; a
    cell without reports for ttl seconds is forgotten."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bank, waits, open_, heard = pickle.loads(state.get[0]) if state.exists else (count.CountBank(1, par), None, {}, 0)
        if not state.hasTimedOut:
            for part in parts:
                for seen in part["first_seen"].tolist():
                    start = seen // width * width
                    heard = max(heard, seen)
                    waits = start if waits is None else waits
                    if start >= waits:
                        open_[start] = open_.get(start, 0) + 1
        closed = state.getCurrentWatermarkMs() // 1000 - width
        seed = np.array([zlib.crc32("|".join(key).encode())], np.uint64)  # as in batch
        out = []
        while waits is not None and waits <= closed and waits <= heard + ttl:
            lo, hi = bank.step(waits, np.array([open_.pop(waits, 0)]), width)
            out.append((*key, waits, float(count.randomised(lo, hi, seed, bank.windows)[0]), float(count.conservative(lo, hi)[0]), count.VERSION))
            waits += width
        if waits is not None and waits > heard + ttl:
            state.remove()
        else:
            state.update((pickle.dumps((bank, waits, open_, heard)),))
            state.setTimeoutTimestamp(max((waits + width) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["stream_id", "cell", "bin_start", "q_value", "q_detect", "model_version"])

    timed = stream.withColumn("arrived", F.timestamp_seconds("first_seen")).withWatermark("arrived", f"{grace} seconds")
    rows = timed.select("stream_id", "cell", "first_seen", "arrived").groupBy("stream_id", "cell")
    return rows.applyInPandasWithState(run, _ROW, "model binary", "append", GroupStateTimeout.EventTimeTimeout)


def split_by_flavor(stream: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(point values, counted observations) of a stream, by the flavor of its source (stream_id, flavor); others are dropped."""
    known = stream.join(sources.select("stream_id", "flavor"), "stream_id")
    return known.where("flavor = 'continuous'").drop("flavor"), known.where("flavor = 'count'").drop("flavor")


def running_evidence(scores: DataFrame, drift: float = 2.0, memory: int = DAY) -> DataFrame:
    """(stream_id, cell, bin_start, q, s) of scored rows as they come: s = max(0, s before - ln p - drift), two-sided.

    Rows at or before the last of their series are passed over; after a gap of memory seconds s
    starts at zero."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, s = state.get if state.exists else (None, 0.0)
        out = []
        rows = pd.concat(list(parts)).sort_values("bin_start")
        for at, q in zip(rows["bin_start"].tolist(), rows["q"].tolist()):
            if q is None or np.isnan(q) or (last is not None and at <= last):
                continue
            s = 0.0 if last is not None and at - last > memory else s
            p = min(max(2 * min(q, 1 - q), 1e-300), 1.0)
            last, s = at, max(0.0, s - float(np.log(p)) - drift)
            out.append((*key, at, q, s))
        if last is not None:
            state.update((last, s))
        yield pd.DataFrame(out, columns=["stream_id", "cell", "bin_start", "q", "s"])

    rows = scores.select("stream_id", "cell", "bin_start", "q").groupBy("stream_id", "cell")
    return rows.applyInPandasWithState(run, "stream_id string, cell string, bin_start long, q double, s double", "last long, s double", "append", GroupStateTimeout.NoTimeout)


def live_candidates(evidence: DataFrame, now: int, threshold: float = 4.0, fresh: int = 3 * 3600) -> DataFrame:
    """The latest row of each series whose s has reached the threshold, if it is fresh."""
    last = evidence.groupBy("stream_id", "cell").agg(F.max_by(F.struct("bin_start", "q", "s"), "bin_start").alias("r")).select("stream_id", "cell", "r.*")
    return last.where((F.col("s") >= threshold) & (F.col("bin_start") >= now - fresh))


def throttle(stream: DataFrame, every: int, jump: float) -> DataFrame:
    """A value is passed on if every seconds went by since the last one, or if it differs from that by the jump."""

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["ts", "value"])
        keep = []
        for ts, y in zip(rows["ts"].tolist(), rows["value"].tolist()):
            passed = last is None or ts - last >= every or abs(y - value) >= jump
            keep.append(passed)
            if passed:
                last, value = ts, y
        if last is not None:
            state.update((last, value))
        yield rows[keep]

    rows = stream.select("stream_id", "cell", "ts", "value").where("value is not null").groupBy("stream_id", "cell")
    return rows.applyInPandasWithState(run, "stream_id string, cell string, ts long, value double", "last long, value double", "append", GroupStateTimeout.NoTimeout)


def into_archive(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Append what is new to a frozen Parquet archive; a batch that is run again writes its folder anew."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path).where(F.col("_batch") != number)
            batch = append_once(batch, stored, key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            batch = batch.dropDuplicates(key)
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
