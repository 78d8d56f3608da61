"""Scoring that goes on from stored state: codecs, runs, pools, commits, seeded streams."""

import uuid
import zlib

import numpy as np
import pytest

from calibra.models import continuous, count, state
from calibra.models.pool import TreePool


def test_states_come_back_as_they_were():
    rng, par = np.random.default_rng(1), continuous.ContinuousParams(periods=(86400.0,), n_harmonics=2)
    st, bank = continuous.ContinuousState(), count.CountBank(1, count.CountParams(seasonal_hour=True))
    for i in range(50):
        st, *_ = continuous.step(st, par, i * 3600, float(rng.normal()))
        bank.step(i * 3600, rng.poisson(2, 1), 3600)
    again = state.point_state(state.point_bytes(st), par)
    assert continuous.step(again, par, 200_000, 1.0)[1] == continuous.step(st, par, 200_000, 1.0)[1]
    other, last = state.count_state(state.count_bytes(bank, 0, 49 * 3600), bank.par)
    assert last == 49 * 3600 and np.array_equal(other.step(50 * 3600, np.array([3]), 3600), bank.step(50 * 3600, np.array([3]), 3600))
    empty = state.point_state(state.point_bytes(continuous.ContinuousState()), par)
    assert empty.t0 == -1 and not len(empty.x)


@pytest.mark.parametrize("harm", [lambda b: None, lambda b: b"", lambda b: b[:-3], lambda b: b"\x63\x00" + b[2:], lambda b: b + b"x"])
def test_states_that_cannot_be_read_say_so(harm):
    with pytest.raises(state.Unreadable):
        state.point_state(harm(state.point_bytes(continuous.step(continuous.ContinuousState(), continuous.ContinuousParams(), 0, 1.0)[0])), continuous.ContinuousParams())
    with pytest.raises(state.Unreadable):
        state.count_state(harm(state.count_bytes(count.CountBank(1))), count.CountParams())
    with pytest.raises(state.Unreadable):  # another design
        state.point_state(state.point_bytes(continuous.step(continuous.ContinuousState(), continuous.ContinuousParams(), 0, 1.0)[0]), continuous.ContinuousParams(periods=(60.0,)))


def _bins(spark, rng, until):
    rows = [(s, c, scale, i * 300 * 2**scale, int(rng.poisson(3)), None if s == "p" and i % 9 == 4 else float(rng.normal())) for s in ("p", "n", "old", "odd") for c in ("a", "b") for scale in (0, 1) for i in range(until // 2**scale)]
    return spark.createDataFrame(rows, "stream_id string, cell string, scale int, bin_start long, n long, vmean double")


def test_runs_go_on_from_stored_states(spark):
    """Three runs equal one; open bins wait; retired streams, odd flavors and points without a value are passed over."""
    from calibra.operators.archive import KEY, ROWS, STATES, Source, score_closed_bins

    sources = {"p": Source("continuous"), "n": Source("count"), "old": Source("count", "retired"), "odd": Source("rate")}
    bins = _bins(spark, np.random.default_rng(2), 40).cache()
    rows, states = spark.createDataFrame([], ROWS), spark.createDataFrame([], STATES)
    whole = score_closed_bins(bins, rows, states, sources, 12_000)
    for now in (5_000, 5_000, 9_000, 12_000):
        run = score_closed_bins(bins, rows, states, sources, now)
        if now == 5_000 and rows.count():
            assert run.all.count() == 0  # the same run again
        rows, states = rows.unionByName(run.rows), states.unionByName(run.states)
        assert run.resets.count() == 0
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, whole.rows.collect()), key=repr)
    found = rows.select("stream_id", "scale", "bin_start", "q_detect").collect()
    assert {r.stream_id for r in found} == {"p", "n"} and not any(r.stream_id == "p" and r.bin_start == 1200 and r.scale == 0 for r in found)
    assert all(r.bin_start + 300 * 2**r.scale + 1200 <= 12_000 for r in found)
    st, par = continuous.ContinuousState(), continuous.ContinuousParams()
    seed = zlib.crc32(b"p|a")
    for r in bins.where("stream_id = 'p' AND cell = 'a' AND scale = 0 AND vmean IS NOT NULL AND bin_start <= 10500").orderBy("bin_start").collect():
        st, q, _ = continuous.step(st, par, r.bin_start, r.vmean, seed)
    assert rows.where("stream_id = 'p' AND cell = 'a' AND scale = 0").agg({"q_value": "max"}).first()[0] is not None
    assert rows.where("stream_id = 'p' AND cell = 'a' AND scale = 0").orderBy("bin_start").collect()[-1].q_value == q
    assert states.groupBy(*KEY).count().count() == 8


def test_states_of_another_version_start_cold(spark):
    from pyspark.sql import functions as F

    from calibra.operators.archive import ROWS, STATES, Source, score_closed_bins

    sources = {"p": Source("continuous"), "n": Source("count")}
    bins = _bins(spark, np.random.default_rng(3), 30)
    first = score_closed_bins(bins, spark.createDataFrame([], ROWS), spark.createDataFrame([], STATES), sources, 5_000)
    broken = first.states.withColumn("state", F.when(F.col("cell") == "a", F.expr("substring(state, 1, 20)")).otherwise(F.col("state")))
    second = score_closed_bins(bins, first.rows, broken, sources, 9_000)
    assert {(r.stream_id, r.cell) for r in second.resets.collect()} == {("p", "a"), ("n", "a")}
    starts = second.rows.groupBy("stream_id", "cell", "scale").agg(F.min_by("q_value", "bin_start").alias("q")).collect()
    assert all((r.q == 0.5) == (r.cell == "a") for r in starts)


@pytest.mark.parametrize("shard", [2, 256])
def test_distributed_pool_equals_the_tree_pool(spark, shard):
    """Shards of nodes, levels by joins: the quantiles of one pool with all of a region, to 1e-9."""
    from calibra.operators import pooling

    rng = np.random.default_rng(4)
    cells = ["q000", "q001", "q003", "q010", "q011", "q022", "q100", "q133", "q20", "q211"]
    rates = rng.gamma(0.7, 1.0, len(cells))
    y = rng.poisson(rates, (40, len(cells)))
    rows = [("s", c, t * 3600, None if y[t, i] == 0 and i == 2 else int(y[t, i])) for t in range(40) for i, c in enumerate(cells)]
    frame = spark.createDataFrame(rows, "stream_id string, cell string, win_start long, n long").repartition(3)
    got = {(r.cell, r.bin_start): (r.q_value, r.q_detect) for r in pooling.score_pooled(frame, 3600, nodes_a_shard=shard).collect()}
    assert len(got) == 400
    for region in ("q0", "q1", "q2"):
        own = [c for c in cells if c.startswith(region)]
        pool, seeds = TreePool(own), np.array([zlib.crc32(f"s|{c}".encode()) for c in own], np.uint64)
        for t in range(40):
            lo, hi = pool.step(t * 3600, np.array([y[t, cells.index(c)] for c in own]), 3600)
            q, d = count.randomised(lo, hi, seeds, pool.bank.windows[pool.leaves]), count.conservative(lo, hi)
            for i, c in enumerate(own):
                assert got[c, t * 3600] == pytest.approx((q[i], d[i]), abs=1e-9)


def test_never_pooling_is_each_cell_alone():
    rng, cells = np.random.default_rng(5), [f"q0{i}{j}" for i in range(2) for j in range(3)]
    pool, alone = TreePool(cells, rho=1e-12), count.CountBank(6)
    for t in range(200):
        y = rng.poisson(0.3, 6)
        assert np.allclose(pool.step(t * 300, y, 300), alone.step(t * 300, y, 300), atol=1e-6)


def test_a_pool_is_restored_and_takes_new_cells():
    rng, cells = np.random.default_rng(6), ["q000", "q001", "q010", "q013"]
    pool = TreePool(cells)
    for t in range(60):
        pool.step(t * 300, rng.poisson(1, 4), 300)
    again = TreePool([*cells, "q032"])
    again.restore({k: (v[1], v[2]) for k, v in pool.stored(59 * 300).items()})
    assert again.score[again.number["q032"]] == again.empty_score
    y = rng.poisson(1, 4)
    lo, hi = again.step(60 * 300, np.array([*y, 2]), 300)
    assert np.all(hi > lo) and not (lo[-1] == 0.5 and hi[-1] == 0.5)  # its ancestors know something
    same = TreePool(cells)
    same.restore({k: (v[1], v[2]) for k, v in pool.stored(59 * 300).items()})
    assert np.array_equal(same.step(60 * 300, y, 300), pool.step(60 * 300, y, 300))


def test_weights_follow_the_data():
    """A hot cell keeps its own model; quiet cells lean on their ancestors."""
    rng, cells = np.random.default_rng(7), [f"q0{i}{j}" for i in range(4) for j in range(4)]
    pool = TreePool(cells)
    for t in range(1500):
        pool.step(t * 300, rng.poisson(np.where(np.arange(16) == 0, 2.0, 0.002)), 300)
    w = pool.weights()
    assert w[0][0] > 0.99 and np.mean([1 - x[0] for x in w[1:]]) > 0.3


def test_a_run_that_dies_changes_nothing(spark, tmp_path):
    from calibra.operators.commits import Store, declared_type

    schema = "k long, v string, version long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    store = Store(spark, str(tmp_path / "s"))
    assert store.manifest().number == 0 and store.rows("t", schema).count() == 0
    store.export({"t": (make((1, "a", 1), (2, "b", 2)), "version"), "none": (make(), "version")}, {"dim": make((9, "x", 0))}, at=5)
    store.write_batch("t", make((3, "half", 3)), 2)  # dies before its manifest
    assert sorted(r.k for r in store.rows("t", schema).collect()) == [1, 2] and store.manifest().marks == {"t": 2}
    rows = make((1, "a2", 3), (2, "b", 2), (4, "c", 4))
    store.export({"t": (rows, "version")})
    assert {(r.k, r.v) for r in store.current("t", schema, ["k"], "version").collect()} == {(1, "a2"), (2, "b"), (4, "c")}
    assert store.export({"t": (rows, "version")}).number == 2 and store.rows("t", schema).count() == 5  # the mark's row twice
    assert {(r.k, r.v) for r in store.current("t", schema, ["k"], "version", number=1).collect()} == {(1, "a"), (2, "b")}
    store.export({}, {"dim": make((9, "y", 0))})
    assert store.create_views() == ["dim"] and spark.sql("SELECT v FROM dim").first().v == "y" and store.snapshot("dim", 1).first().v == "x"
    with pytest.raises(RuntimeError):
        store._publish(store.manifest())  # two runs of one number
    assert [declared_type(t) for t in ("INTEGER", "bigint", "VARCHAR(9)", "clob", "BLOB", "", "REAL", "NUMERIC")] == ["bigint", "bigint", "string", "string", "binary", "binary", "double", "double"]


def _stream(spark, folder, parts, schema):
    """A stream that reads one file a batch, in order."""
    path = f"{folder}/{uuid.uuid4().hex}"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


OBS = "stream_id string, cell string, first_seen long"


def test_seeded_counts_of_a_silent_and_a_new_cell(spark, tmp_path):
    from calibra.plans.streams import run
    from calibra.streaming import seeded

    cells = spark.createDataFrame([("s", "quiet"), ("s", "a"), ("t", "gone")], "stream_id string, cell string")
    parts = [[("s", "a", 1000 + 60 * i) for i in range(40)], [("s", "b", 4000), ("s", "a", 4100)], [("s", "a", 9000), ("s", "b", 9900)]]
    rows = run(seeded.seeded_counts(_stream(spark, tmp_path, parts, OBS), seeded.registered(cells, 700, 600), 600, ttl=5000)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.bin_start):
        got.setdefault((r.stream_id, r.cell), []).append(r)
    # registered at 700: windows from 600 on; 9900 - 60 closes those up to 9000; silent for 5000 s: forgotten
    assert [r.bin_start for r in got["s", "quiet"]] == list(range(600, 5701, 600))
    assert [r.bin_start for r in got["s", "a"]] == list(range(600, 9001, 600))
    assert [r.bin_start for r in got["s", "b"]] == list(range(3600, 9001, 600)) and [r.bin_start for r in got["t", "gone"]] == list(range(600, 5701, 600))
    bank, seed = count.CountBank(1), np.array([zlib.crc32(b"s|a")], np.uint64)
    seen = [x for p in parts for s, c, x in p if c == "a"]
    for r in got["s", "a"]:
        lo, hi = bank.step(r.bin_start, np.array([sum(r.bin_start <= x < r.bin_start + 600 for x in seen)]), 600)
        assert r.q_value == count.randomised(lo, hi, seed, bank.windows)[0]


def test_seeded_counts_go_on_from_a_stored_model(spark, tmp_path):
    from calibra.plans.streams import run
    from calibra.streaming import seeded

    bank = count.CountBank(1)
    for t in range(0, 6000, 600):
        bank.step(t, np.array([2]), 600)
    states = spark.createDataFrame([("s", "a", bytearray(state.count_bytes(bank, 0, 5400))), ("s", "b", bytearray(b"junk"))], "stream_id string, cell string, state binary")
    cells = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "stream_id string, cell string")
    stream = _stream(spark, tmp_path, [[("s", "a", 6100), ("s", "a", 6200)], [("s", "a", 8000)]], OBS)
    rows = run(seeded.seeded_counts(stream, seeded.registered(cells, 6600, 600, states), 600)).collect()
    first = {r.cell: r for r in sorted(rows, key=lambda r: -r.bin_start)}
    lo, hi = bank.step(6000, np.array([2]), 600)
    assert first["a"].bin_start == 6000 and first["a"].q_value == count.randomised(lo, hi, np.array([zlib.crc32(b"s|a")], np.uint64), bank.windows)[0]
    assert first["b"].bin_start == first["c"].bin_start == 6600 and first["b"].q_value == first["c"].q_value == 0.5


def test_restored_sums_go_on_like_a_stream_that_ran_through(spark, tmp_path):
    from calibra.plans.streams import run
    from calibra.streaming import live, seeded

    rng = np.random.default_rng(8)
    rows = [(s, "c", int(t), float(q)) for s in ("x", "y") for t, q in zip(np.cumsum(rng.integers(300, 3000, 60)), rng.beta(0.4, 0.4, 60))]
    schema = "stream_id string, cell string, bin_start long, q double"
    cut = sorted(r[2] for r in rows)[len(rows) // 2]
    through = {tuple(r)[:3]: r.s for r in run(live.running_evidence(_stream(spark, tmp_path, [rows], schema), memory=10**9)).collect()}
    sums = seeded.restored_sums(spark.createDataFrame(rows, schema), cut, lookback=10**9)
    later = [r for r in rows if r[2] >= cut]
    got = run(seeded.restored_evidence(_stream(spark, tmp_path, [later[::2], later[1::2]][:1] + [sorted(later[1::2], key=lambda r: r[2])], schema), sums, memory=10**9)).collect()
    assert got  # rows that come behind a later one of their series are passed over
    got = run(seeded.restored_evidence(_stream(spark, tmp_path, [later], schema), sums, memory=10**9)).collect()
    assert len(got) == len(later) and all(r.s == pytest.approx(through[tuple(r)[:3]], abs=1e-9) for r in got)


def test_links_of_messages_in_any_batches(spark, tmp_path):
    """Heartbeats, breaks and whole windows by a plain clock, for any cut of the messages into batches."""
    from calibra.plans.streams import run
    from calibra.streaming import seeded

    rng = np.random.default_rng(9)
    times = sorted({int(x) for x in np.cumsum(rng.choice([5, 20, 40, 700], 150, p=[0.5, 0.3, 0.18, 0.02]))})
    messages = [("s", t, float(i)) for i, t in enumerate(times)]
    cadence, stale, width = 100, 300, 60

    def clock():
        out, st = [], None
        value = dict((t, v) for _, t, v in messages)
        for now in range(times[0], times[-1] + 1):
            if st:
                if now == st["win"] + width:
                    if st["win"] >= st["opened"] and st["held"]:
                        out.append(("s", st["win"], "window", len(st["held"]), sum(st["held"]) / len(st["held"])))
                    st["win"], st["held"] = now, []
                if now == st["beat"]:
                    out.append(("s", now, "ok", st["since"], None))
                    st["beat"], st["since"] = now + cadence, 0
                if now == st["last"] + stale + 1:
                    out.append(("s", now, "reconnect", 0, None))
                    st = None
            if now in value:
                if not st:
                    st = {"opened": now, "beat": now + cadence, "since": 0, "win": now // width * width, "held": [], "last": now}
                    out.append(("s", now, "connected", 0, None))
                st["last"], st["since"] = now, st["since"] + 1
                st["held"].append(value[now])
        return sorted(out, key=repr)

    want = clock()
    assert {e for _, _, e, _, _ in want} == {"connected", "ok", "reconnect", "window"}
    for cuts in ([], [40], [1, 2, 30, 90, 91]):
        parts = [messages[i:j] for i, j in zip([0, *cuts], [*cuts, len(messages)])]
        got = run(seeded.supervised_links(_stream(spark, tmp_path, parts, "stream_id string, received long, value double"), cadence, stale, width)).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_live_pool_takes_a_cell_that_reports_late(spark, tmp_path):
    from calibra.plans.streams import run
    from calibra.streaming import seeded

    seeds = spark.createDataFrame([("s", c, 0) for c in ("q00", "q01", "q10")], "stream_id string, cell string, waits long")
    parts = [[("s", "q00", 10 + 300 * i) for i in range(8)], [("s", "q02", 3000), ("s", "q00", 3100)], [("s", "q10", 6000)]]
    rows = run(seeded.pooled_counts(_stream(spark, tmp_path, parts, OBS), seeds, 600)).collect()
    starts = {}
    for r in rows:
        starts.setdefault(r.cell, []).append(r.bin_start)
    assert sorted(starts["q00"]) == list(range(0, 5400, 600)) == sorted(starts["q10"])
    assert sorted(starts["q02"]) == list(range(3000, 5400, 600)) and sorted(starts["q01"]) == sorted(starts["q00"])
    assert all(0 <= r.q_value <= 1 for r in rows)
