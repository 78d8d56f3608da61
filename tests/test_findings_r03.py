"""Faults that a review found: each test failed before its fix."""

import json

import duckdb
import numpy as np
import pytest

from calibra.functions.special import betainc
from calibra.models import continuous
from calibra.models.count import SIZES, point_and_below
from calibra.operators import archive, scoring
from calibra.plans.catalog import ORACLES, QUERIES
from calibra.sources import generic
from calibra.sources.feeds import parse


def test_documents_of_one_text_stay_apart(spark):
    """Two users' documents with the same text give two observations, not one."""
    body = json.dumps({"items": [{"id": i, "lat": 1.0, "lon": 1.0, "when": 1000 + i} for i in range(4)]})
    docs = spark.createDataFrame([("doc/1", 7, body), ("doc/2", 7, body)], "url string, received_at long, body string")
    spec = generic.Records("active", generic.fixed("here"), "items", time_format="epoch")
    found = parse("cell_aggregate", docs, spec=spec, how="distinct", least=3, record_time="when", zero_cells=("here", "there")).collect()
    assert sorted((r.cell, r.ts, r.value) for r in found) == [("here", 1003, 4.0)] * 2 + [("there", 1003, 0.0)] * 2


def events(spark, folder, rows):
    """A folder with an events table of (event_id, seconds, user_id, event_type, value)."""
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    frame.selectExpr("event_id", "timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00') AS ts", "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def equal_to_sql(spark, name, folder):
    ours = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cols = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    found = sorted(map(tuple, ours.select(*cols).collect()), key=str)
    assert found == sorted(theirs, key=str)
    return found


def test_verdict_is_that_of_the_highest_id(spark, tmp_path):
    """Ids beyond a million, and not in the order of time."""
    folder = events(spark, tmp_path / "t", [(5_000_000, 10, 1, "click", 90.0), (7, 4_000, 1, "click", 1.0), (3, 5, 2, "view", 1.0), (2_500_000, 3, 2, "view", 80.0)])
    assert [r[2] for r in equal_to_sql(spark, "latest_verdict_join", folder)] == ["pass", "pass"]


def test_ratio_at_the_null_point(spark, tmp_path):
    """A record at 0, 0 (id 85 of user 180) counts, and so does its day as a document's newest."""
    folder = events(spark, tmp_path / "t", [(85, 86400 * 2, 180, "click", 1.0), (255, 0, 180, "view", 1.0), (86, 86400, 180, "click", 1.0), (87, 86400 * 3, 180, "click", 1.0), (425, 86400 * 4, 180, "click", 1.0)])
    assert any(r[0] == "0_0" for r in equal_to_sql(spark, "record_ratio_parser", folder))


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_an_alert_is_parsed_once(spark):
    """Filters on the fields of an alert don't parse its text again."""
    assert plan_of(QUERIES["cap_alert_parser"](spark, "/root/testdata/sf0.001")).count("from_xml(") == 1


def test_fields_of_box_means_are_read_once(spark):
    """Eight paths: three of an entry, five of a day."""
    assert plan_of(QUERIES["box_mean_parser"](spark, "/root/testdata/sf0.001")).count("get_json_object(") == 8


@pytest.mark.parametrize("quantum", [0.0, 0.5])
def test_quantiles_together_equal_those_one_by_one(monkeypatch, quantum):
    """A series' quantiles come from one call, the same to the bit as step by step."""
    par, rng = continuous.ContinuousParams(quantum=quantum), np.random.default_rng(3)
    times, values = list(range(0, 600_000, 2000)), rng.standard_t(3, 300).tolist()
    st, found, single, one = continuous.ContinuousState(), [], [], continuous.ContinuousState()
    for t, y in zip(times, values):
        st, where = continuous.advance(st, par, t, y)
        found.append(where)
        one, *q = continuous.step(one, par, t, y, 9)
        single.append(tuple(q))
    calls, whole = [], continuous.t_cdf
    monkeypatch.setattr(continuous, "t_cdf", lambda x, df: calls.append(len(x)) or whole(x, df))
    assert list(zip(*continuous.quantiles(par, times, found, 9))) == single
    assert calls == [300] * (2 if quantum else 1)


def test_the_beta_fraction_of_a_number_is_its_own():
    a, b, x = np.array([0.5, 40.0, 900.0]), np.array([0.5, 700.0, 30.0]), np.array([0.3, 0.05, 0.97])
    together = betainc(a, b, x)
    assert together.tolist() == [float(betainc(*v)) for v in zip(a, b, x)]


@pytest.mark.parametrize("y", [0, 1, 17, 128])
def test_counts_of_one_series_are_summed_alike(y):
    """The shorter sums of a bank of one series give the bits of a bank of two."""
    size, p = SIZES[:-1][None, :, None], np.random.default_rng(1).uniform(0.01, 0.99, (1, 9, 24))
    one, two = point_and_below(np.full((1, 1, 1), float(y)), size, p), point_and_below(np.full((2, 1, 1), float(y)), size, np.repeat(p, 2, 0))
    assert all((b[:1] == a).all() for a, b in zip(one, two))


def test_bins_of_a_point_series_are_scored_together(monkeypatch):
    """One call of the t distribution for all bins, those without a mean left out; cut anywhere the bits are the same."""
    source, rng = archive.Source("continuous"), np.random.default_rng(5)
    bins = [(i * 19200, 1, None if i % 7 == 3 else float(y)) for i, y in enumerate(rng.normal(size=90))]
    whole, cut = archive.PointScorer(source, 4), archive.PointScorer(source, 4)
    calls, real = [], continuous.t_cdf
    monkeypatch.setattr(continuous, "t_cdf", lambda x, df: calls.append(len(x)) or real(x, df))
    together = whole.scores(bins)
    assert calls == [sum(b[2] is not None for b in bins)] and [q is None for q in together] == [b[2] is None for b in bins]
    assert cut.scores(bins[:41]) + cut.scores(bins[41:42]) + cut.scores(bins[42:]) == together
    assert whole.stored() == cut.stored()


def bits(st):
    return repr((st.x.tobytes(), st.p.tobytes(), float(st.s), float(st.n), st.t0, st.last))


@pytest.mark.parametrize("par", [continuous.ContinuousParams(level_var=1e-4), continuous.ContinuousParams(quantum=0.5), continuous.ContinuousParams(quantum=1.0, transform="log1p"), continuous.ContinuousParams(periods=(86400.0,))])
@pytest.mark.parametrize("kind", ["usual", "heavy", "constant", "infinite"])
def test_many_steps_equal_single_ones(monkeypatch, par, kind):
    """Where values lie and the state after them are those of single steps; only harmonics and infinities take array steps."""
    rng = np.random.default_rng(11)
    times = np.cumsum(rng.integers(1, 5000, 400)).tolist()
    values = {"usual": rng.exponential(2, 400), "heavy": np.abs(rng.standard_cauchy(400)) * 100, "constant": np.full(400, 3.0), "infinite": np.r_[rng.exponential(2, 399), np.inf]}[kind].tolist()
    if par.transform:
        values = np.log1p(values).tolist()
    st, one = continuous.ContinuousState(), []
    with np.errstate(all="ignore"):
        for ts, y in zip(times, values):
            st, where = continuous.advance(st, par, ts, y)
            one.append(where)
        calls, real = [], continuous.advance
        monkeypatch.setattr(continuous, "advance", lambda *args: calls.append(1) or real(*args))
        cut, first = continuous.follow(continuous.ContinuousState(), par, times[:150], values[:150])
        cut, none = continuous.follow(cut, par, [], [])
        cut, rest = continuous.follow(cut, par, times[150:], values[150:])
    assert none == [] and np.array_equal(np.array(first + rest, float), np.array(one, float), equal_nan=True) and bits(cut) == bits(st)
    assert len(calls) == (400 if par.periods else 251 if kind == "infinite" else 1)


def test_a_scale_of_zero_does_not_stop_a_series():
    par, st = continuous.ContinuousParams(), continuous.ContinuousState(np.array([1.0, 0.0]), np.zeros((2, 2)), 0.0, 2.0, 5, 5)
    with np.errstate(all="ignore"):
        end, found = continuous.follow(st, par, [10, 20], [1.0, 2.0])
    assert len(found) == 2 and end.last == 20


def test_point_series_are_read_in_batches(spark):
    """Series cut anywhere give the scores of plain steps, no task holds a series, and the first of one time counts whatever the order of rows."""
    rng = np.random.default_rng(4)
    rows = [("s", cell, 1000 + int(t), float(y), i) for i, (cell, t, y) in enumerate(zip(rng.choice(["a", "b", "c"], 150).tolist(), rng.integers(0, 120, 150), rng.normal(size=150)))]
    rows += [("s", None, 1000 + i, float(i), 200 + i) for i in range(9)] + [("s", "a", 1, None, 300), ("s", "a", 2, float("nan"), 301), ("s", "b", None, 1.0, 302)]
    frame = spark.createDataFrame(rows[::-1], "stream_id string, cell string, ts long, value double, event_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        scored = scoring.score_points(frame, order="event_id")
        assert "FlatMapGroups" not in plan_of(scored)
        got = {(r.cell, r.bin_start): r.q_value for r in scored.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for cell in ("a", "b", "c", None):
        st, last = continuous.ContinuousState(), None
        for _, _, ts, y, _ in sorted((r for r in rows if r[1] == cell and r[2] is not None and r[3] is not None and not np.isnan(r[3])), key=lambda r: (r[2], r[4])):
            if ts != last:
                st, q, _ = continuous.step(st, continuous.ContinuousParams(), ts, y)
                want[cell, ts], last = q, ts
    assert got == want


def test_of_one_time_the_first_event_counts(spark, tmp_path):
    """Later rows of a second are left out by their ids, in whatever order they lie in the file."""
    first = [(i, 100 * i, 1, "error", float(10 + i)) for i in range(6)]
    late = [(100 + i, 100 * i, 1, "error", 900.0) for i in range(6)]
    alone, mixed = events(spark, tmp_path / "a", first), events(spark, tmp_path / "b", (first + late)[::-1])
    scores = [sorted(map(tuple, QUERIES["continuous_model_q"](spark, folder).collect())) for folder in (alone, mixed)]
    assert scores[0] == scores[1] and len(scores[0]) == 6
