"""Batch scoring: sequential models as maps over time-ordered series.

Point series are independent: they are read in the order of their times, a batch at a time.
Count series are scored many at a time: a group is one stream's shard of cells, whose models
advance together window by window. Pooled counts are in operators.pooling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.models import continuous, count, presence, tdigest

ROW = "stream_id string, cell string, bin_start long, q_value double, q_detect double, model_version int"


def score_points(obs: DataFrame, par: continuous.ContinuousParams = continuous.ContinuousParams(), order: str = "value") -> DataFrame:
    """Quantiles of point series (stream_id, cell, ts, value); null values and times unscored.

    Of the rows of one time the first by the column `order` counts, later repeats are left out.
    A task reads its series one after the other in sorted batches, and holds a batch and a model."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series = state = last = seed = None
        for batch in batches:
            for key, rows in batch.groupby(["stream_id", "cell"], sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != series:
                    series, state, last, seed = key, continuous.ContinuousState(), None, zlib.crc32(f"{key[0]}|{key[1]}".encode())
                times = rows["ts"].tolist()
                rows = rows[[ts != before for ts, before in zip(times, [last, *times])]]
                last, times = times[-1], rows["ts"].tolist()
                state, found = continuous.follow(state, par, times, rows["value"].tolist())
                out, cautious = continuous.quantiles(par, times, found, seed)
                yield pd.DataFrame({"stream_id": rows["stream_id"], "cell": rows["cell"], "bin_start": rows["ts"], "q_value": out, "q_detect": pd.Series(cautious, index=rows.index, dtype="float64"), "model_version": continuous.VERSION})

    known = obs.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).select("stream_id", "cell", "ts", "value", F.col(order).alias("_order"))
    return known.repartition("stream_id", "cell").sortWithinPartitions("stream_id", "cell", "ts", "_order").drop("_order").mapInPandas(run, ROW)


def score_counts(windows: DataFrame, width: int, cells_a_group: int = 256, par: count.CountParams = count.CountParams()) -> DataFrame:
    """Quantiles of count windows (stream_id, cell, win_start, n), quiet windows included."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="win_start", columns="cell", values="n", aggfunc="sum", fill_value=0).sort_index()
        stream, cells = rows["stream_id"].iloc[0], table.columns.tolist()
        seeds = np.array([zlib.crc32(f"{stream}|{c}".encode()) for c in cells], np.uint64)
        bank, parts, last = count.CountBank(len(cells), par), [], None
        for ts, y in zip(table.index.tolist(), table.to_numpy(np.int64)):
            lo, hi = bank.step(ts, y, width if last is None else ts - last)
            last = ts
            parts.append(pd.DataFrame({"stream_id": stream, "cell": cells, "bin_start": ts, "q_value": count.randomised(lo, hi, seeds, bank.windows), "q_detect": count.conservative(lo, hi), "model_version": count.VERSION}))
        return pd.concat(parts)

    n_cells = windows.select(F.approx_count_distinct("cell")).first()[0]
    shard = F.pmod(F.xxhash64("cell"), F.lit(max(1, n_cells // cells_a_group)))
    return windows.select("stream_id", "cell", "win_start", "n", shard.alias("shard")).groupBy("stream_id", "shard").applyInPandas(run, ROW)


def score_presence(slots: DataFrame) -> DataFrame:
    """Silence quantile of each polled slot of a component (component, slot, reported)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        state, out = presence.PresenceState(), []
        for slot, reported in zip(rows["slot"].tolist(), rows["reported"].tolist()):
            state, q = presence.step(state, slot, bool(reported))
            out.append(q)
        return pd.DataFrame({"component": rows["component"], "slot": rows["slot"], "presence_q": out})

    return slots.select("component", "slot", "reported").groupBy("component").applyInPandas(run, "component string, slot long, presence_q double")


def digests(obs: DataFrame, by: list[str]) -> DataFrame:
    """A t-digest of the values of each key: one of each part of a key, then merged, so no task holds a key's values."""
    part = F.pmod(F.xxhash64("ts", "value"), F.lit(32)).cast("int")
    keys = obs.select(*by).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "digest": [tdigest.build(rows["value"].to_numpy())], "n": [len(rows)]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "digest": [tdigest.merge(rows["digest"].tolist())], "n": [rows["n"].sum()]})

    schema = f"{keys}, digest binary, n long"
    parts = obs.where("value is not null").select(*by, "value", part.alias("_part")).groupBy(*by, "_part").applyInPandas(build, schema)
    return parts.groupBy(*by).applyInPandas(merge, schema)
