"""Robust dynamic harmonic regression for point values, one step at a time.

State: level, trend and harmonics with covariance, a learned noise scale with discounted
degrees of freedom, the time origin and the last time. A step returns the quantile of what
was observed under the prediction made before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import sqrt

import numpy as np

from calibra.functions.special import t_cdf

VERSION = 3


@dataclass(frozen=True)
class ContinuousParams:
    obs_scale: float = 1.0
    obs_dof: float = 4.0
    level_var: float = 1e-2
    trend_var: float = 1e-6
    seasonal_var: float = 1e-4
    time_scale: float = 3600.0
    prior_dof: float = 1.0
    memory: float = 7 * 86400.0
    periods: tuple[float, ...] = ()
    n_harmonics: int = 1
    quantum: float = 0.0
    transform: str = ""


@dataclass
class ContinuousState:
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    p: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    s: float = 0.0
    n: float = 0.0
    t0: int = -1
    last: int = -1


def _design(par: ContinuousParams, tau: float) -> np.ndarray:
    z = [1.0, 0.0]
    for period in par.periods:
        for h in range(1, par.n_harmonics + 1):
            z += [np.sin(2 * np.pi * h * tau / period), np.cos(2 * np.pi * h * tau / period)]
    return np.array(z)


def _evolved(st: ContinuousState, par: ContinuousParams, ts: int):
    """(x, P, n, z) carried to a time."""
    dt = max(1e-9, (ts - st.last) / par.time_scale)
    x, p = st.x.copy(), st.p.copy()
    x[0] += dt * x[1]
    p[0] += dt * p[1]
    p[:, 0] += dt * p[:, 1]
    var = np.full(len(x), par.seasonal_var)
    var[0], var[1] = par.level_var, par.trend_var
    p[np.diag_indices(len(x))] += var * dt * st.s / par.obs_scale**2
    keep = np.exp(-(ts - st.last) / par.memory)
    return x, p, keep * st.n + (1 - keep) * par.prior_dof, _design(par, float(ts - st.t0))


def predict(st: ContinuousState, par: ContinuousParams, ts: int) -> tuple[float, float]:
    """Location and scale of the next value, the state unchanged."""
    x, p, _, z = _evolved(st, par, ts)
    return float(z @ x), float(np.sqrt(z @ p @ z + st.s))


def edges(par: ContinuousParams, y: float) -> tuple[float, float]:
    """Modelled values at the ends of the interval that rounding to the quantum hides."""
    half = par.quantum / 2
    if par.transform == "log1p":
        return float(np.log1p(max(np.expm1(y) - half, -1 + 1e-12))), float(np.log1p(np.expm1(y) + half))
    if par.transform == "log":
        return float(np.log(max(np.exp(y) - half, 1e-12))), float(np.log(np.exp(y) + half))
    return y - half, y + half


def _uniform(seed: int, ts: int) -> float:
    """A number in [0, 1) from a fixed hash of a series' seed and a time."""
    x = (seed * 0x9E3779B97F4A7C15 + ts * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 29)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) / (1 << 64)


def advance(st: ContinuousState, par: ContinuousParams, ts: int, y: float) -> tuple[ContinuousState, tuple[float, float, float]]:
    """State after a value, and where the value lies under the prediction before it: both ends of
    the interval that is known of it, in units of the prediction's scale, and the degrees of
    freedom (of the first value: NaN)."""
    scale = par.obs_scale**2
    if st.t0 < 0:
        k = 2 + 2 * len(par.periods) * par.n_harmonics
        x = np.zeros(k)
        x[0] = y
        var = np.full(k, 10.0)
        var[1] = 1.0
        return ContinuousState(x, np.diag(var) * scale, scale, par.prior_dof, ts, ts), (np.nan, np.nan, np.nan)
    x, p, n, z = _evolved(st, par, ts)
    at, v = float(z @ x), float(z @ p @ z)
    spread, error = v + st.s, y - at
    root, dof, rounding = np.sqrt(max(spread, 1e-12)), min(n, par.obs_dof), 0.0
    low = high = error / root
    if par.quantum:
        a, b = edges(par, y)
        low, high, rounding = (a - at) / root, (b - at) / root, (b - a) ** 2 / 12
    w = (par.obs_dof + 1) / (par.obs_dof + error * error / spread)
    gain = p @ z / (v + st.s / w)
    x = x + gain * error
    p = p - np.outer(gain, z @ p)
    p = (p + p.T) / 2
    square = max(error * error - rounding, -spread / 2)
    s = st.s * (n + w * square / spread) / (n + w)
    return ContinuousState(x, p * (s / st.s), s, n + w, st.t0, ts), (low, high, dof)


def _level_and_trend(st: ContinuousState, par: ContinuousParams, times: list[int], values: list[float]) -> tuple[ContinuousState, list[tuple[float, float, float]]]:
    """follow() of a model that has begun and has no harmonics, in plain numbers.

    The operations are those of advance in their order, without its products by the design 1, 0."""
    scale, top, found = par.obs_scale**2, par.obs_dof, []
    gaps = np.diff(np.array([st.last, *times], np.int64))
    dts, keeps = np.maximum(1e-9, gaps / par.time_scale).tolist(), np.exp(-gaps / par.memory).tolist()
    (x0, x1), ((p00, p01), (_, p11)), s, n = st.x.tolist(), st.p.tolist(), float(st.s), float(st.n)
    for dt, keep, y in zip(dts, keeps, values):
        x0 += dt * x1
        p00 += dt * p01
        p01 += dt * p11
        p00 = p00 + dt * p01 + par.level_var * dt * s / scale
        p11 += par.trend_var * dt * s / scale
        n = keep * n + (1 - keep) * par.prior_dof
        spread, error = p00 + s, y - x0
        root, rounding = sqrt(max(spread, 1e-12)), 0.0
        low = high = error / root
        if par.quantum:
            a, b = edges(par, y)
            low, high, rounding = (a - x0) / root, (b - x0) / root, (b - a) ** 2 / 12
        found.append((low, high, min(n, top)))
        w = (top + 1) / (top + error * error / spread)
        by = p00 + s / w
        gain0, gain1 = p00 / by, p01 / by
        x0 += gain0 * error
        x1 += gain1 * error
        p00, p01, p11 = p00 - gain0 * p00, ((p01 - gain0 * p01) + (p01 - gain1 * p00)) / 2, p11 - gain1 * p01
        before, s = s, s * (n + w * max(error * error - rounding, -spread / 2) / spread) / (n + w)
        grown = s / before
        p00, p01, p11, n = p00 * grown, p01 * grown, p11 * grown, n + w
    return ContinuousState(np.array([x0, x1]), np.array([[p00, p01], [p01, p11]]), np.float64(s), np.float64(n), st.t0, times[-1]), found


def follow(st: ContinuousState, par: ContinuousParams, times: list[int], values: list[float]) -> tuple[ContinuousState, list[tuple[float, float, float]]]:
    """advance() over many values in the order of their time: the last state, and where each value lies.

    Results are those of single steps to the bit; models without harmonics take far less time a value."""
    found = []
    if st.t0 < 0 and times:
        st, where = advance(st, par, times[0], values[0])
        found, times, values = [where], times[1:], values[1:]
    if times and st.t0 >= 0 and not par.periods and st.p[0, 1] == st.p[1, 0] and np.isfinite(st.x).all() and (np.abs(values) < 1e100).all():
        try:
            st, more = _level_and_trend(st, par, times, values)
            return st, found + more
        except ZeroDivisionError:  # a scale of zero, for which NumPy's numbers have a result
            st = replace(st, s=np.float64(st.s), n=np.float64(st.n))
    for ts, y in zip(times, values):
        st, where = advance(st, par, ts, y)
        found.append(where)
    return st, found


def quantiles(par: ContinuousParams, times: list[int], found: list[tuple[float, float, float]], seed: int = 0) -> tuple[list[float], list[float | None]]:
    """Quantiles and quantiles for tail decisions of values by where they lie, all in one go.

    The first value has 0.5. Of a value known to a quantum only an interval of quantiles is
    known: the first quantile is drawn from it by the series' seed, the second is the one
    closest to one half; of other values there is no second one."""
    low, high, dof = np.array(found, float).reshape(-1, 3).T
    new = np.isnan(dof)
    dof = np.where(new, 1.0, dof)
    lo = np.where(new, 0.5, t_cdf(np.where(new, 0.0, low), dof))
    if not par.quantum:
        return lo.tolist(), [None] * len(lo)
    hi = np.where(new, 0.5, t_cdf(np.where(new, 0.0, high), dof))
    drawn = np.array([_uniform(seed, ts) for ts in times])
    cautious = np.where(lo > 0.5, lo, np.where(hi < 0.5, hi, 0.5))
    return (lo + drawn * (hi - lo)).tolist(), [None if first else c for first, c in zip(new.tolist(), cautious.tolist())]


def step(st: ContinuousState, par: ContinuousParams, ts: int, y: float, seed: int = 0) -> tuple[ContinuousState, float, float | None]:
    """State after a value, the value's quantile, and the quantile for tail decisions (see quantiles)."""
    st, found = advance(st, par, ts, y)
    (q,), (cautious,) = quantiles(par, [ts], [found], seed)
    return st, q, cautious
