"""Bayesian dynamic Gamma-Poisson counts over a grid of dispersions, for many series at once.

A bank holds one model for each of its series and advances all of them by one window. Sizes k
of the grid run from strong overdispersion to Poisson (infinite size); each size has a Gamma
rate of its own. Rates and the weights over the grid are discounted. Hours of the day and days
of the week have profiles if the parameters ask for them. Quantiles come as the interval [F(y-1), F(y)], from which
the randomised and the conservative quantile are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from calibra.functions.special import gammaincinv, nb_cdf, nb_logpmf

VERSION = 2
# Finite sizes of the grid (the last entry stands for Poisson) and quadrature nodes.
SIZES = np.array([0.25, 0.5, 1, 2, 4, 8, 16, 32, 64, np.inf])
NODES = (np.arange(24) + 0.5) / 24


#: Counts up to here are summed term by term, larger ones go through the incomplete beta function.
SUMMED = 128
_SHAPES = np.exp(np.linspace(np.log(1e-3), np.log(200.0), 500))
_table: np.ndarray | None = None


def gamma_nodes(a: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(a, 1) at NODES: from a table in log a, by the cube-root normal beyond it."""
    global _table
    if _table is None:
        _table = np.log(np.maximum(gammaincinv(_SHAPES[:, None], NODES[None]), 1e-300))
    at = np.interp(np.log(np.clip(a, _SHAPES[0], _SHAPES[-1])), np.log(_SHAPES), np.arange(len(_SHAPES)))
    i = np.minimum(at.astype(int), len(_SHAPES) - 2)
    low = np.exp(_table[i] + (at - i)[:, None] * (_table[i + 1] - _table[i]))
    normal = (_table[-1] - np.log(_SHAPES[-1])) / 3  # log of the cube root at the last shape
    z = (np.exp(normal) - 1 + 1 / (9 * _SHAPES[-1])) * 3 * np.sqrt(_SHAPES[-1])
    high = a[:, None] * (1 - 1 / (9 * a[:, None]) + z / (3 * np.sqrt(a[:, None]))) ** 3
    return np.where(a[:, None] > _SHAPES[-1], high, low)


def point_and_below(y: np.ndarray, size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(y), F(y-1)) of negative binomials."""
    if y.max(initial=0) > SUMMED:
        return np.exp(nb_logpmf(y, size, p)), nb_cdf(y - 1, size, p)
    term = p**size
    if y.size == 1:  # the sums below, without the choice between series
        below, rest = np.zeros_like(term), 1 - p
        for j in range(int(y.max())):
            below += term
            term = term * (j + size)
            term /= j + 1
            term *= rest
        return term, below
    below, point = np.zeros_like(term), np.where(y == 0, term, 0.0)
    for j in range(int(y.max(initial=0))):
        below = below + np.where(j < y, term, 0.0)
        term = term * (j + size) / (j + 1) * (1 - p)
        point = np.where(y == j + 1, term, point)
    return point, below


@dataclass(frozen=True)
class CountParams:
    a0: float = 0.5
    b0: float = 1e-3
    memory: float = 3 * 86400.0
    seasonal_rate: float = 0.05
    seasonal_hour: bool = False
    seasonal_dow: bool = False


class CountBank:
    """Models of n series."""

    def __init__(self, n: int, par: CountParams = CountParams()) -> None:
        self.par = par
        self.a, self.b = np.full((n, len(SIZES)), par.a0), np.full((n, len(SIZES)), par.b0)
        self.logw = np.full((n, len(SIZES)), -np.log(len(SIZES)))
        self.hours, self.days = np.zeros((n, 24)), np.zeros((n, 7))
        self.windows, self.keep = np.zeros(n, np.int64), 1.0

    def exposure(self, ts: int) -> np.ndarray:
        """Expected share of a window at a time, from the profiles in use."""
        e = np.zeros(len(self.a))
        if self.par.seasonal_hour:
            e = e + self.hours[:, ts // 3600 % 24]
        if self.par.seasonal_dow:
            e = e + self.days[:, (ts // 86400 + 4) % 7]
        return np.maximum(np.exp(e), 1e-9)

    def discount(self, seconds: float) -> None:
        """Forget a part of the rates' evidence; that of the weights goes when they learn."""
        self.keep = keep = float(np.exp(-max(0.0, seconds) / self.par.memory))
        self.a, self.b = keep * self.a + (1 - keep) * self.par.a0, keep * self.b + (1 - keep) * self.par.b0

    def predictive(self, y: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(y), P(< y)) of each series and size."""
        finite = self.a[:, :-1]
        nodes = gamma_nodes(finite.ravel()).reshape(*finite.shape, len(NODES))
        rate = np.maximum(nodes / self.b[:, :-1, None] * e[:, None, None], 1e-12)
        k = SIZES[:-1][None, :, None]
        pmf, below = point_and_below(y[:, None, None].astype(float), k, k / (k + rate))
        last, last_below = point_and_below(y.astype(float), self.a[:, -1], self.b[:, -1] / (self.b[:, -1] + e))
        return np.concatenate([pmf.mean(2), last[:, None]], axis=1), np.concatenate([below.mean(2), last_below[:, None]], axis=1)

    def step(self, ts: int, y: np.ndarray, seconds: float) -> tuple[np.ndarray, np.ndarray]:
        """Advance by one window: (F(y-1), F(y)) of each series; a first window has (0.5, 0.5)."""
        first = self.windows == 0
        self.discount(seconds)
        e = self.exposure(ts)
        pmf, below = self.predictive(y, e)
        w = np.exp(self.logw)
        lo = np.where(first, 0.5, np.clip((w * below).sum(1), 0, 1))
        hi = np.where(first, 0.5, np.clip(lo + (w * pmf).sum(1), 0, 1))
        self.learn(ts, y, e, np.where(first[:, None], 1.0, pmf))
        return lo, hi

    def learn(self, ts: int, y: np.ndarray, e: np.ndarray, pmf: np.ndarray) -> None:
        known, rate = self.windows > 0, self.a / self.b
        mean = (np.exp(self.logw) * rate).sum(1) * e
        self.logw = self.keep * self.logw + np.log(np.maximum(pmf, 1e-12))
        self.logw -= self.logw.max(1, keepdims=True)
        self.logw -= np.log(np.exp(self.logw).sum(1, keepdims=True))
        k = SIZES[:-1][None]
        shrink = np.ones_like(self.a)
        shrink[:, :-1] = np.where(known[:, None], (k + y[:, None]) / (k + rate[:, :-1] * e[:, None]), 1.0)
        self.a = self.a + y[:, None]
        self.b = self.b + e[:, None] * shrink
        tilt = np.where(known, np.log((y + 0.5) / (mean + 0.5)), 0.0) * self.par.seasonal_rate
        for used, profile, slot in ((self.par.seasonal_hour, self.hours, ts // 3600 % 24), (self.par.seasonal_dow, self.days, (ts // 86400 + 4) % 7)):
            if used:
                profile[:, slot] += tilt
                profile -= profile.mean(1, keepdims=True)
        self.windows += 1


def randomised(lo: np.ndarray, hi: np.ndarray, seeds: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A quantile within [lo, hi] from a fixed hash of the series' seed and window number."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + windows.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return lo + (x >> np.uint64(11)).astype(float) / (1 << 53) * (hi - lo)


def conservative(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.where(lo > 0.5, lo, np.where(hi < 0.5, hi, 0.5))
