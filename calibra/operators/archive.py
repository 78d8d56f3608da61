"""Scoring of closed bins run by run: each run goes on from the stored model states.

A run takes the bins beyond each series' cursor, the last bin that the archive holds of it, and
the newest stored state; it gives new archive rows, new states and the series that had to start
afresh. The archive is frozen: a bin is scored once, and only when nothing can be added to it.
Running again over the same bins adds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.bins import bin_width
from calibra.models import continuous, count, state
from calibra.operators.shared import written

KEY = ["stream_id", "cell", "scale"]
#: Seconds until a bin is whole: the fine window of the fold and one more pass.
SETTLE = 900 + 300
ROWS = "stream_id string, cell string, scale int, bin_start long, q_value double, presence_q double, precision double, n_obs long, model_version int, q_detect double"
STATES = "stream_id string, cell string, scale int, version int, state binary, updated_at long"
RESETS = "stream_id string, cell string, scale int, ts long, detail string"
_OUT = "kind string, stream_id string, cell string, scale int, bin_start long, q_value double, n_obs long, model_version int, q_detect double, state binary, detail string"


@dataclass(frozen=True)
class Source:
    """What the configuration says of a stream's model."""

    flavor: str
    status: str = "live"
    par: continuous.ContinuousParams | count.CountParams | None = None

    def params(self) -> continuous.ContinuousParams | count.CountParams:
        return self.par or (continuous.ContinuousParams() if self.flavor == "continuous" else count.CountParams())


@dataclass
class Run:
    """Results of a run: archive rows, states to store, series whose stored state couldn't be read."""

    rows: DataFrame
    states: DataFrame
    resets: DataFrame
    all: DataFrame = field(repr=False)


class PointScorer:
    """A point series' model behind the calls that all flavors have."""

    def __init__(self, source: Source, seed: int, blob: bytes | None = None) -> None:
        self.par, self.seed = source.params(), seed
        self.st = state.point_state(blob, self.par) if blob is not None else continuous.ContinuousState()

    def scores(self, bins: list[tuple[int, int, float | None]]) -> list[tuple[float, float | None] | None]:
        """Quantiles of bins (start, n, mean) in their order; none of a bin without a mean."""
        known = [not (mean is None or np.isnan(mean)) for _, _, mean in bins]
        times, means = [b[0] for b, good in zip(bins, known) if good], [float(b[2]) for b, good in zip(bins, known) if good]
        self.st, found = continuous.follow(self.st, self.par, times, means)
        told = zip(*continuous.quantiles(self.par, times, found, self.seed))
        return [next(told) if good else None for good in known]

    def stored(self) -> bytes:
        return state.point_bytes(self.st)


class CountScorer:
    def __init__(self, source: Source, seed: int, blob: bytes | None = None) -> None:
        self.seed = np.array([seed], np.uint64)
        self.bank, self.last = state.count_state(blob, source.params()) if blob is not None else (count.CountBank(1, source.params()), -1)

    def scores(self, bins: list[tuple[int, int, float | None]]) -> list[tuple[float, float | None] | None]:
        return [self._score(ts, n) for ts, n, _ in bins]

    def _score(self, ts: int, n: int) -> tuple[float, float | None]:
        lo, hi = self.bank.step(ts, np.array([n], np.int64), ts - self.last if self.last >= 0 else 0)
        self.last = ts
        return float(count.randomised(lo, hi, self.seed, self.bank.windows)[0]), float(count.conservative(lo, hi)[0])

    def stored(self) -> bytes:
        return state.count_bytes(self.bank, 0, self.last)


#: Model of each flavor; streams of other flavors are passed over.
SCORERS = {"continuous": PointScorer, "count": CountScorer}


def opened(source: Source, stream_id: str, cell: str, blob: bytes | None) -> tuple[PointScorer | CountScorer, str | None]:
    """(model, why it starts cold although a state was stored)."""
    make, seed = SCORERS[source.flavor], zlib.crc32(f"{stream_id}|{cell}".encode())
    if blob is None:
        return make(source, seed), None
    try:
        return make(source, seed, blob), None
    except state.Unreadable as why:
        return make(source, seed), str(why)


def newest_states(states: DataFrame) -> DataFrame:
    """The stored state of the highest version of each series; of one version the last stored."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("version"), F.desc("updated_at"))
    return states.withColumn("_i", F.row_number().over(order)).where("_i = 1").select(*KEY, "version", "state")


def score_closed_bins(bins: DataFrame, archive: DataFrame, states: DataFrame, sources: Mapping[str, Source], now: int, settle: int = SETTLE) -> Run:
    """One run over bins (stream_id, cell, scale, bin_start, n, vmean).

    archive: the rows of all runs so far; states: all stored states. A bin is closed once its
    end lies settle seconds back. Retired streams, unknown streams and flavors without a model
    are passed over; a point bin without a mean isn't scored. The series' own bins meet its
    state in a cogroup, so a task holds the new bins of one series at a time: one narrow row a
    bin, at most the bins of the time since the last run. Written to the shared folder."""
    live = {k: s for k, s in sources.items() if s.status != "retired" and s.flavor in SCORERS}
    closed = bins.where(F.col("stream_id").isin(*live)).where(F.col("bin_start") <= F.lit(now - settle) - bin_width(F.col("scale")))
    cursor = archive.groupBy(*KEY).agg(F.max("bin_start").alias("_cursor"))
    fresh = closed.join(cursor, KEY, "left").where(F.col("_cursor").isNull() | (F.col("bin_start") > F.col("_cursor"))).select(*KEY, "bin_start", "n", "vmean")
    stored = newest_states(states).select(*KEY, "state")

    def run(key: tuple, rows: pd.DataFrame, state_: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _OUT.split(", ")]
        if not len(rows):
            return pd.DataFrame([], columns=names)
        stream_id, cell, scale = key
        source = live[stream_id]
        model, why = opened(source, stream_id, cell, state_["state"].iloc[0] if len(state_) else None)
        version, out = state.VERSIONS[source.flavor], []
        rows = rows.sort_values("bin_start")
        bins_ = list(zip(rows["bin_start"].tolist(), rows["n"].tolist(), rows["vmean"].tolist()))
        for (at, n, _), scored in zip(bins_, model.scores(bins_)):
            if scored is not None:
                q, detect = scored
                out.append(("row", *key, at, q, n, version, None if detect == q else detect, None, None))
        if out:
            out.append(("state", *key, None, None, None, version, None, model.stored(), None))
            if why:
                out.append(("reset", *key, None, None, None, version, None, None, why))
        found = pd.DataFrame(out, columns=names)
        return found.astype({"bin_start": "Int64", "n_obs": "Int64", "q_value": "float64", "q_detect": "float64"})

    done = written(fresh.groupBy(*KEY).cogroup(stored.groupBy(*KEY)).applyInPandas(run, _OUT))
    rows = done.where("kind = 'row'").select(*KEY, "bin_start", "q_value", F.lit(1.0).alias("presence_q"), F.lit(1.0).alias("precision"), "n_obs", "model_version", F.when(~F.isnan("q_detect"), F.col("q_detect")).alias("q_detect"))
    new = done.where("kind = 'state'").select(*KEY, F.col("model_version").alias("version"), "state", F.lit(now).cast("long").alias("updated_at"))
    return Run(rows, new, done.where("kind = 'reset'").select(*KEY, F.lit(now).cast("long").alias("ts"), "detail"), done)
