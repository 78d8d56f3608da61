"""Live state that starts from what is known: registered cells, restored sums, whole pools, links.

Each operator is a stateful processor whose initial state comes from a table, so that a stream
that was stopped goes on as one that ran through, and a cell that is expected to report is
scored from its registration on. The clock is the watermark of arrival; with the processing
time mode of a link it is the wall clock.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from calibra.models import count, state
from calibra.models.pool import TreePool
from calibra.operators.pooling import POOLED

DAY = 86400
_ROW = "stream_id string, cell string, bin_start long, q_value double, q_detect double, model_version int"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _timed(stream: DataFrame, grace: int) -> DataFrame:
    return stream.withColumn("arrived", F.timestamp_seconds("first_seen")).withWatermark("arrived", f"{grace} seconds")


def _seed(*names: str) -> int:
    return zlib.crc32("|".join(names).encode())


def registered(cells: DataFrame, at: int, width: int, states: DataFrame | None = None) -> DataFrame:
    """Seeds (stream_id, cell, waits, heard, state) of cells (stream_id, cell) registered at a time.

    states (stream_id, cell, state): stored models; a cell with one waits for the window after
    its last, another for the window of the registration."""
    start = F.lit(at - at % width).cast("long")
    if states is None:
        return cells.select("stream_id", "cell", start.alias("waits"), F.lit(at).cast("long").alias("heard"), F.lit(None).cast("binary").alias("state"))
    return cells.join(states.select("stream_id", "cell", "state"), ["stream_id", "cell"], "left").select("stream_id", "cell", start.alias("waits"), F.lit(at).cast("long").alias("heard"), "state")


class SeededCounts(StatefulProcessor):
    """One cell: its model, the window it waits for, and counts of windows that are still open."""

    def __init__(self, width: int, ttl: int, par: count.CountParams) -> None:
        self.width, self.ttl, self.par = width, ttl, par

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", "waits long, heard long, state binary")
        self.open = handle.getMapState("open", "win_start long", "n long")

    def _wake(self, waits: int) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer((waits + self.width) * 1000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        waits, heard, blob = (initialState[c].iloc[0] for c in ("waits", "heard", "state"))
        waits = int(waits)
        try:
            _, last = state.count_state(blob, self.par)
            waits = last + self.width if last >= 0 else waits
        except state.Unreadable:  # none stored, or another version's: the cell starts cold
            blob = None
        self.model.update((waits, int(heard), blob))
        self._wake(waits)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waits, heard, blob = self.model.get() if self.model.exists() else (None, 0, None)
        new: dict[int, int] = {}
        for part in rows:
            for seen in part["first_seen"].tolist():
                new[seen // self.width * self.width] = new.get(seen // self.width * self.width, 0) + 1
                heard = max(heard, seen)
        waits = min(new) if waits is None else waits
        for start, n in new.items():
            if start >= waits:
                was = self.open.getValue((start,)) if self.open.containsKey((start,)) else None
                self.open.updateValue((start,), (n + (was[0] if was else 0),))
        self.model.update((int(waits), int(heard), blob))
        self._wake(int(waits))
        yield _frame([], _ROW)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waits, heard, blob = self.model.get()
        bank, last = state.count_state(blob, self.par) if blob is not None else (count.CountBank(1, self.par), -1)
        closed, out, seed = timerValues.getCurrentWatermarkInMs() // 1000 - self.width, [], np.array([_seed(*key)], np.uint64)
        while waits <= closed and waits <= heard + self.ttl:
            n = 0
            if self.open.containsKey((waits,)):
                n = self.open.getValue((waits,))[0]
                self.open.removeKey((waits,))
            lo, hi = bank.step(waits, np.array([n], np.int64), self.width)
            last = waits
            out.append((*key, waits, float(count.randomised(lo, hi, seed, bank.windows)[0]), float(count.conservative(lo, hi)[0]), count.VERSION))
            waits += self.width
        if waits > heard + self.ttl:
            self.model.clear()
            self.open.clear()
        else:
            self.model.update((int(waits), int(heard), state.count_bytes(bank, 0, last)))
            self._wake(int(waits))
        yield _frame(out, _ROW)


def seeded_counts(stream: DataFrame, seeds: DataFrame, width: int, grace: int = 60, ttl: int = 30 * DAY, par: count.CountParams = count.CountParams()) -> DataFrame:
    """Quantiles of closed windows of arrival of registered and of reporting cells, quiet windows included.

    seeds: see registered(). A window closes when the watermark passes its end; a cell without
    reports for ttl seconds is forgotten."""
    rows = _timed(stream, grace).select("stream_id", "cell", "first_seen", "arrived").groupBy("stream_id", "cell")
    return rows.transformWithStateInPandas(SeededCounts(width, ttl, par), _ROW, "append", "eventTime", seeds.groupBy("stream_id", "cell"))


_SUMS = "stream_id string, cell string, bin_start long, q double, s double"


def _log_p(q: float) -> float:
    return float(np.log(min(max(2 * min(q, 1 - q), 1e-300), 1.0)))


def _advance(last: int | None, s: float, at: int, q: float, drift: float, memory: int) -> float:
    s = 0.0 if last is not None and at - last > memory else s
    return max(0.0, s - _log_p(q) - drift)


def restored_sums(archive: DataFrame, now: int, drift: float = 2.0, lookback: int = DAY) -> DataFrame:
    """(stream_id, cell, last, s): running evidence of each series over the archive's rows of the lookback before now.

    archive: stream_id, cell, bin_start, q. The sum is that of series.cusum: the running total
    less the least total so far."""
    x = -F.ln(F.least(F.greatest(2 * F.least(F.col("q"), 1 - F.col("q")), F.lit(1e-300)), F.lit(1.0))) - drift
    by = Window.partitionBy("stream_id", "cell").orderBy("bin_start").rowsBetween(Window.unboundedPreceding, 0)
    rows = archive.where((F.col("bin_start") >= now - lookback) & (F.col("bin_start") < now) & F.col("q").isNotNull()).withColumn("_t", F.sum(x).over(by))
    sums = rows.withColumn("s", F.col("_t") - F.least(F.lit(0.0), F.min("_t").over(by)))
    return sums.groupBy("stream_id", "cell").agg(F.max("bin_start").alias("last"), F.max_by("s", "bin_start").alias("s"))


class RestoredSums(StatefulProcessor):
    """One series: the time of its last row and its running evidence."""

    def __init__(self, drift: float, memory: int) -> None:
        self.drift, self.memory = drift, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sum = handle.getValueState("sum", "last long, s double")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.sum.update((int(initialState["last"].iloc[0]), float(initialState["s"].iloc[0])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, s = self.sum.get() if self.sum.exists() else (None, 0.0)
        out = []
        for at, q in pd.concat(list(rows)).sort_values("bin_start")[["bin_start", "q"]].itertuples(index=False):
            if q is None or np.isnan(q) or (last is not None and at <= last):
                continue
            last, s = int(at), _advance(last, s, int(at), float(q), self.drift, self.memory)
            out.append((*key, last, float(q), s))
        if last is not None:
            self.sum.update((last, s))
        yield _frame(out, _SUMS)


def restored_evidence(scores: DataFrame, sums: DataFrame, drift: float = 2.0, memory: int = DAY) -> DataFrame:
    """(stream_id, cell, bin_start, q, s) of scored rows as they come, going on from restored_sums."""
    rows = scores.select("stream_id", "cell", "bin_start", "q").groupBy("stream_id", "cell")
    return rows.transformWithStateInPandas(RestoredSums(drift, memory), _SUMS, "append", "none", sums.groupBy("stream_id", "cell"))


class PooledWindows(StatefulProcessor):
    """The cells of one coarsest region: models and evidence of its nodes, and counts of open windows.

    A timer closes a window for all cells of the region at once."""

    def __init__(self, width: int, coarsest: int, rho: float, par: count.CountParams) -> None:
        self.width, self.coarsest, self.rho, self.par = width, coarsest, rho, par

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "waits long")
        self.nodes = handle.getMapState("nodes", "node string", "since long, score double, state binary")  # since: the first window of a cell; null for the nodes above
        self.open = handle.getMapState("open", "cell string, win_start long", "n long")

    def _wake(self, waits: int) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer((waits + self.width) * 1000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        begin = int(initialState["waits"].min())
        begin = min(begin, self.waits.get()[0]) if self.waits.exists() else begin
        for cell, since in zip(initialState["cell"].tolist(), initialState["waits"].tolist()):
            self.nodes.updateValue((cell,), (int(since), 0.0, b""))
        self.waits.update((begin,))
        self._wake(begin)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, int], int] = {}
        for part in rows:
            for cell, seen in zip(part["cell"].tolist(), part["first_seen"].tolist()):
                at = (cell, seen // self.width * self.width)
                counts[at] = counts.get(at, 0) + 1
        waits = self.waits.get()[0] if self.waits.exists() else min(start for _, start in counts)
        for (cell, start), n in sorted(counts.items()):
            if not self.nodes.containsKey((cell,)):
                self.nodes.updateValue((cell,), (max(start, waits), 0.0, b""))
            if start >= waits:
                was = self.open.getValue((cell, start))[0] if self.open.containsKey((cell, start)) else 0
                self.open.updateValue((cell, start), (was + n,))
        self.waits.update((int(waits),))
        self._wake(int(waits))
        yield _frame([], _ROW)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waits, out = self.waits.get()[0], []
        closed = timerValues.getCurrentWatermarkInMs() // 1000 - self.width
        if waits <= closed:
            stored = {k[0]: v for k, v in self.nodes.iterator()}
            since = {k: v[0] for k, v in stored.items() if v[0] is not None}
            known = {k: (v[1], v[2]) for k, v in stored.items() if v[2]}
            held, pool = {k: v[0] for k, v in self.open.iterator()}, None
            while waits <= closed:
                cells = sorted(k for k, first in since.items() if first <= waits)
                if cells and (pool is None or cells != pool.cells):  # cells join with their first window
                    known |= {k: v[1:] for k, v in pool.stored(waits - self.width).items()} if pool else {}
                    pool = TreePool(cells, self.coarsest, self.rho, self.par)
                    pool.restore(known)
                    seeds = np.array([_seed(key[0], c) for c in cells], np.uint64)
                if pool:
                    lo, hi = pool.step(waits, np.array([held.get((c, waits), 0) for c in cells], np.int64), self.width)
                    q, cautious = count.randomised(lo, hi, seeds, pool.bank.windows[pool.leaves]), count.conservative(lo, hi)
                    out += [(key[0], c, waits, float(a), float(b), POOLED) for c, a, b in zip(cells, q, cautious)]
                waits += self.width
            for at in held:
                if at[1] < waits:
                    self.open.removeKey(at)
            for node, (_, score, blob) in pool.stored(waits - self.width).items() if pool else ():
                self.nodes.updateValue((node,), (since.get(node), score, blob))
            self.waits.update((int(waits),))
        self._wake(int(waits))
        yield _frame(out, _ROW)


def pooled_counts(stream: DataFrame, seeds: DataFrame, width: int, coarsest: int = 1, grace: int = 60, rho: float = 0.1, par: count.CountParams = count.CountParams()) -> DataFrame:
    """Quantiles of closed windows of arrival of quadtree cells, pooled over each coarsest region.

    seeds (stream_id, cell, waits): cells that are known from a window on. A region's state is a
    map of its nodes; a cell that first reports later joins with a model that knows nothing,
    which has no weight until its second window."""
    region = F.substring("cell", 1, coarsest + 1)
    rows = _timed(stream, grace).select("stream_id", region.alias("region"), "cell", "first_seen", "arrived").groupBy("stream_id", "region")
    initial = seeds.select("stream_id", region.alias("region"), "cell", "waits").groupBy("stream_id", "region")
    return rows.transformWithStateInPandas(PooledWindows(width, coarsest, rho, par), _ROW, "append", "eventTime", initial)


_LINK = "stream_id string, ts long, event string, n long, mean double"


class Link(StatefulProcessor):
    """One link: its opening, its last message, the next heartbeat and the window being filled.

    Messages reach the state in batches, so what a clock would have done between two of them is
    done in the order of time: for each message, first the heartbeats, the end of the window and
    the silence that came before it."""

    def __init__(self, cadence: int, stale: int, width: int) -> None:
        self.cadence, self.stale, self.width = cadence, stale, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", "opened long, last long, beat long, since_beat long, win long, n long, total double")

    def _until(self, key: tuple, now: int, st: list, out: list) -> None:
        """Heartbeats, closed windows and a broken link up to a time; st is the state as a list."""
        while st[0] is not None:
            opened, last, beat, since, win, n, total = st
            ends = [beat, win + self.width, last + self.stale + 1]
            at = min(ends)
            if at > now:
                return
            if at == ends[1]:  # a window is passed on if the link was open all through it
                if win >= opened and n:
                    out.append((*key, win, "window", n, total / n))
                st[4:] = [win + self.width, 0, 0.0]
            elif at == ends[0]:
                out.append((*key, beat, "ok", since, None))
                st[2:4] = [beat + self.cadence, 0]
            else:
                out.append((*key, at, "reconnect", 0, None))
                st[0] = None

    def _run(self, key: tuple, messages: list[tuple[int, float]], now: int | None) -> pd.DataFrame:
        st = list(self.link.get()) if self.link.exists() else [None] * 7
        out: list[tuple] = []
        for at, value in messages:
            self._until(key, at, st, out)
            if st[0] is None:
                st = [at, at, at + self.cadence, 0, at // self.width * self.width, 0, 0.0]
                out.append((*key, at, "connected", 0, None))
            st[1], st[3], st[5], st[6] = max(st[1], at), st[3] + 1, st[5] + 1, st[6] + value
        if now is not None:
            self._until(key, now, st, out)
        self.link.update(tuple(st))
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if st[0] is not None:
            self.handle.registerTimer(min(st[2], st[4] + self.width, st[1] + self.stale + 1) * 1000)
        return _frame(out, _LINK)

    def _now(self, timerValues, expired=None) -> int:
        return max(timerValues.getCurrentWatermarkInMs(), timerValues.getCurrentProcessingTimeInMs() if timerValues.getCurrentWatermarkInMs() < 0 else -1) // 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values(["received", "value"])
        yield self._run(key, list(zip(held["received"].tolist(), held["value"].tolist())), None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run(key, [], self._now(timerValues))


def supervised_links(messages: DataFrame, cadence: int, stale: int, width: int, late: int = 0, clock: str = "eventTime") -> DataFrame:
    """(stream_id, ts, event, n, mean) of the links of message streams (stream_id, received, value).

    connected: the first message, or the first after a break; ok: once a cadence, with the number
    of messages since the last; reconnect: no message for more than stale seconds, after which
    the link counts as broken; window: number and mean of the messages of an aligned window of
    width seconds that the link was open all through (those in which it opened or broke are
    dropped). clock eventTime: time is the watermark of arrival, late seconds behind the newest
    message, so that landed messages give the same rows; processingTime: the wall clock."""
    timed = messages.withColumn("arrived", F.timestamp_seconds("received"))
    rows = (timed.withWatermark("arrived", f"{late} seconds") if clock == "eventTime" else timed).groupBy("stream_id")
    return rows.transformWithStateInPandas(Link(cadence, stale, width), _LINK, "append", clock)
