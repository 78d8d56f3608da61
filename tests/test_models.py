"""Models and special functions against plain formulas, and joins on fixtures against brute force."""

import math

import numpy as np
import pytest

from calibra.functions.special import gammaincinv
from calibra.models.count import SIZES, CountBank, CountParams, conservative, randomised


def gamma_quantiles(a, u):
    """Quantiles of Gamma(a, 1) by bisection on a series of its distribution function."""

    def cdf(x):
        if x <= 0:
            return 0.0
        term = total = 1 / a
        for n in range(1, 4000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-17:
                break
        return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))

    lo, hi = 0.0, a + 60 * math.sqrt(a) + 60
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < u else (lo, mid)
    return (lo + hi) / 2


def nb(y, k, p):
    return math.exp(math.lgamma(y + k) - math.lgamma(k) - math.lgamma(y + 1) + k * math.log(p) + y * math.log1p(-p))


def test_gamma_quantiles():
    for a in (0.05, 0.5, 1.0, 3.0, 40.0, 300.0):
        for u in (0.001, 0.02, 0.5, 0.98, 0.999):
            want = gamma_quantiles(a, u)
            assert math.isclose(float(gammaincinv(np.array([a]), np.array([u]))[0]), want, rel_tol=1e-6, abs_tol=1e-12)


class PlainCount:
    """One series, size by size, in plain Python."""

    def __init__(self, par):
        self.par, self.logw = par, [-math.log(len(SIZES))] * len(SIZES)
        self.a, self.b, self.seen = [par.a0] * len(SIZES), [par.b0] * len(SIZES), False
        self.hour = [1.0] * 24

    def step(self, ts, y, seconds):
        keep = math.exp(-seconds / self.par.memory)
        e = self.hour[ts // 3600 % 24] if self.par.seasonal_hour else 1.0
        if not self.seen:
            self.a, self.b, self.seen = [a + y for a in self.a], [b + e for b in self.b], True
            return 0.5, 0.5
        a = [keep * x + (1 - keep) * self.par.a0 for x in self.a]
        b = [keep * x + (1 - keep) * self.par.b0 for x in self.b]
        pmf, below = [], []
        for k, ai, bi in zip(SIZES, a, b):
            if math.isinf(k):
                at = [nb(j, ai, bi / (bi + e)) for j in range(y + 1)]
            else:
                rates = [max(gamma_quantiles(ai, (i + 0.5) / 24) / bi * e, 1e-12) for i in range(24)]
                at = [sum(nb(j, k, k / (k + r)) for r in rates) / 24 for j in range(y + 1)]
            pmf.append(at[-1])
            below.append(sum(at[:-1]))
        w = [math.exp(x) for x in self.logw]
        lo, hi = sum(x * z for x, z in zip(w, below)), sum(x * (z + p) for x, z, p in zip(w, below, pmf))
        mean = sum(x * ai / bi for x, ai, bi in zip(w, a, b)) * e
        logw = [keep * x + math.log(max(p, 1e-12)) for x, p in zip(self.logw, pmf)]
        norm = math.log(sum(math.exp(x) for x in logw))
        self.logw = [x - norm for x in logw]
        shrink = [1.0 if math.isinf(k) else (k + y) / (k + ai / bi * e) for k, ai, bi in zip(SIZES, a, b)]
        self.a, self.b = [x + y for x in a], [x + e * z for x, z in zip(b, shrink)]
        if self.par.seasonal_hour:
            self.hour[ts // 3600 % 24] *= math.exp(self.par.seasonal_rate * math.log((y + 0.5) / (mean + 0.5)))
            middle = math.exp(sum(map(math.log, self.hour)) / 24)
            self.hour = [x / middle for x in self.hour]
        return lo, min(1.0, hi)


@pytest.mark.parametrize("par", [CountParams(), CountParams(seasonal_hour=True)])
def test_counts_equal_the_plain_recursion(par):
    rng = np.random.default_rng(2)
    ys = np.stack([rng.poisson(3, 14), rng.negative_binomial(0.5, 0.1, 14), np.zeros(14, int)], axis=1)
    bank, plain = CountBank(3, par), [PlainCount(par) for _ in range(3)]
    for t, y in enumerate(ys):
        lo, hi = bank.step(t * 7200, y, 7200)
        for i in range(3):
            a, b = plain[i].step(t * 7200, int(y[i]), 7200)
            assert math.isclose(lo[i], a, abs_tol=2e-3) and math.isclose(hi[i], b, abs_tol=2e-3)


def test_count_quantiles_are_uniform():
    """Total variation (Poisson 0.013, bursty counts 0.023, whose rate posterior is approximate) and tail rates."""
    rng, n, windows = np.random.default_rng(4), 200, 400
    for ys in (rng.poisson(rng.uniform(0.2, 20, n), (windows, n)), rng.negative_binomial(2, 2 / (2 + rng.uniform(0.5, 8, n)), (windows, n))):
        bank, seeds, qs, cautious = CountBank(n, CountParams(memory=300 * 3600.0)), np.arange(n, dtype=np.uint64) * np.uint64(7919), [], []
        for t, y in enumerate(ys):
            lo, hi = bank.step(t * 3600, y, 3600)
            if t >= 100:
                qs.append(randomised(lo, hi, seeds, bank.windows))
                cautious.append(conservative(lo, hi))
        q = np.concatenate(qs)
        hist = np.histogram(q, 10, (0, 1))[0] / len(q)
        assert np.abs(hist - 0.1).sum() / 2 <= 0.025
        assert 0.5 <= (q > 0.99).mean() / 0.01 <= 1.6 and 0.5 <= (q < 0.01).mean() / 0.01 <= 1.5
        assert (np.concatenate(cautious) > 0.999).mean() <= 0.003  # nominal: 0.001


def test_swarms_are_seen_sooner_with_pooling_or_alone():
    """One more event an hour for six hours in quiet cells: most swarms cross the alarm threshold."""
    rng, cells = np.random.default_rng(6), 12
    bank, s, seen = CountBank(cells), np.zeros(cells), np.zeros(cells, bool)
    for t in range(24 * 30):
        y = rng.poisson(0.02, cells) + (1 if 24 * 28 <= t < 24 * 28 + 6 else 0)
        lo, hi = bank.step(t * 3600, y, 3600)
        s = np.maximum(0, s - np.log(np.maximum(1 - conservative(lo, hi), 1e-300)) - 2)
        seen |= (s >= 4) & (24 * 28 <= t < 24 * 28 + 7)
    assert seen.sum() >= 9


def test_as_of_bins_over_many_periods(spark):
    from calibra.operators.joins import as_of_bin

    rng = np.random.default_rng(3)
    bins = [("s", f"c{rng.integers(3)}", int(rng.integers(3)), int(rng.integers(60)) * 10, int(i), float(i)) for i in range(80)]
    bins = list({b[:4]: b for b in bins}.values())
    asks = [(i, "s", f"c{rng.integers(4)}", int(rng.integers(3)), int(rng.integers(600))) for i in range(300)]
    got = as_of_bin(spark.createDataFrame(asks, "ask_id long, stream_id string, cell string, scale int, at long"), spark.createDataFrame(bins, "stream_id string, cell string, scale int, bin_start long, n long, vmean double"), period=70).collect()
    assert len(got) == len(asks)
    for r in got:
        own = [b for b in bins if b[1] == r.cell and b[3] <= r.at]
        want = next((b for b in own if (b[2], b[3]) == (r.scale, r.at)), None) or min(own, key=lambda b: (-b[3], b[2]), default=None)
        assert (r.bin_scale, r.bin_start, r.n) == ((want[2], want[3], want[4]) if want else (None, None, None))


def test_nearest_outlines_and_names(spark):
    from calibra.functions.geo import EARTH_KM
    from calibra.operators.places import place_names

    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    outlines = spark.createDataFrame([("Land", "country", 0, 1, box(0.0, 0.0, 2.0, 2.0)), ("Sea", "sea", 1, 1, box(2.0, 0.0, 9.0, 2.0))], "name string, kind string, rank int, ord int, ring array<struct<x:double,y:double>>")
    points = [(1, 1.0, 1.0), (2, 2.1, 1.9), (3, 6.0, 1.0), (4, 0.0, 2.2), (5, 5.0, 60.0), (6, 9.0, 3.0)]
    km = lambda a, b: 2 * EARTH_KM * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))
    assert km((0.0, 2.2), (0.0, 2.0)) < 30 < km((9.0, 3.0), (9.0, 2.0)) < 150
    got = {r.point_id: r.place for r in place_names(spark.createDataFrame(points, "point_id long, lon double, lat double"), outlines).collect()}
    assert got == {1: "Land", 2: "Sea, off Land", 3: "Sea", 4: "Land", 5: "", 6: "Sea"}


def test_configured_tables_have_a_checked_size(spark):
    from calibra.operators.sizes import small

    assert small(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError):
        small(spark.range(11), 10)


def test_unknown_formats_are_errors(spark):
    from calibra.sources.feeds import PARSERS, parse

    assert {"records", "cell_aggregate", "geojson_events", "cap_alerts"} <= PARSERS.keys()
    with pytest.raises(KeyError):
        parse("no such format", spark.range(1))


@pytest.mark.parametrize("transform,quantum", [("", 1.0), ("log1p", 1.0), ("log", 0.5)])
def test_rounded_values_have_cautious_quantiles(transform, quantum):
    """Quantiles of rounded values are uniform; those for tails lie nearer to one half and within the rounding's interval."""
    from calibra.models import continuous

    rng = np.random.default_rng(9)
    par = continuous.ContinuousParams(quantum=quantum, transform=transform, level_var=1e-6, memory=400 * 86400.0)
    forth = {"": lambda v: v, "log": np.log, "log1p": np.log1p}[transform]
    raw = np.maximum(np.round((20 + rng.normal(0, 2, 1500)) / quantum) * quantum, quantum)
    state, qs = continuous.ContinuousState(), []
    for t, v in enumerate(raw):
        state, q, cautious = continuous.step(state, par, 3600 * t, float(forth(v)), seed=5)
        if t > 300:
            qs.append(q)
            assert abs(cautious - 0.5) <= abs(q - 0.5) + 1e-9
    hist = np.histogram(qs, 10, (0, 1))[0] / len(qs)
    assert np.abs(hist - 0.1).sum() / 2 <= 0.09
    lo, hi = continuous.edges(par, float(forth(raw[0])))
    assert math.isclose(lo, float(forth(raw[0] - quantum / 2)), rel_tol=1e-9) and math.isclose(hi, float(forth(raw[0] + quantum / 2)), rel_tol=1e-9)


def test_kll_rank_error(spark):
    """The sketch's quantiles are within two hundredths of their rank."""
    from calibra.plans.catalog import QUERIES
    from calibra.plans.tables import obs

    sf = "/root/testdata/sf0.01"
    values = obs(spark, sf).toPandas().groupby("stream_id").value.apply(lambda x: np.sort(x.to_numpy()))
    out = QUERIES["kll_quantiles"](spark, sf).toPandas()
    for row in out.itertuples():
        own = values[row.stream_id]
        for q, got in ((0.5, row.median), (0.9, row.p90), (0.99, row.p99)):
            assert abs(np.searchsorted(own, got, "right") / len(own) - q) <= 0.02 or abs(np.searchsorted(own, got, "left") / len(own) - q) <= 0.02


def test_cells_rings_and_homes(spark):
    from pyspark.sql import functions as F

    from calibra.functions import geo

    row = spark.range(1).select(
        geo.quad_ring(geo.quad_cell(F.lit(10.0), F.lit(20.0), 2)).alias("ring"), geo.unwrapped(F.array(F.array(F.lit(179.0), F.lit(0.0)), F.array(F.lit(-179.0), F.lit(1.0)))).alias("wide"),
        geo.unwrapped(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(1.0)))).alias("narrow"), geo.homes(F.lit("48.1,11.5; x,2; 35.7 , 139.7;")).alias("homes"),
    ).first()
    assert row.ring == [[0.0, 0.0], [90.0, 0.0], [90.0, 45.0], [0.0, 45.0], [0.0, 0.0]]
    assert row.wide == [[179.0, 0.0], [181.0, 1.0]] and row.narrow == [[1.0, 0.0], [-1.0, 1.0]] and row.homes == [[48.1, 11.5], [35.7, 139.7]]


def test_live_candidates_are_fresh_and_strong(spark):
    from calibra.streaming.live import live_candidates, split_by_flavor

    rows = [("a", "c", 100, 0.9, 5.0), ("a", "c", 200, 0.9, 3.0), ("b", "c", 200, 0.99, 6.0), ("d", "c", -20_000, 0.99, 9.0)]
    got = live_candidates(spark.createDataFrame(rows, "stream_id string, cell string, bin_start long, q double, s double"), 300).collect()
    assert [(r.stream_id, r.s) for r in got] == [("b", 6.0)]
    sources = spark.createDataFrame([("a", "count"), ("b", "continuous"), ("d", "other")], "stream_id string, flavor string")
    points, counts = split_by_flavor(spark.createDataFrame([(x,) for x in "abde"], "stream_id string"), sources)
    assert [r.stream_id for r in points.collect()] == ["b"] and [r.stream_id for r in counts.collect()] == ["a"]
