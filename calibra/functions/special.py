"""Special functions on NumPy arrays: log-gamma, incomplete beta and gamma, and what builds on them."""

from __future__ import annotations

import numpy as np

# Lanczos coefficients (g = 7, n = 9).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def gammaln(x):
    """log of the gamma function for x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    s = np.full(np.shape(z), _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    big = 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        mirrored = np.log(np.pi / np.abs(np.sin(np.pi * x))) - big
    return np.where(small, mirrored, big)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function by Lentz's method.

    A number that has converged is left alone, so its value doesn't depend on the others."""
    shape, out = np.shape(x), np.empty(np.size(x))
    a, b, x, left = np.ravel(a), np.ravel(b), np.ravel(x), np.arange(np.size(x))
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        done = np.abs(d * c - 1) < 1e-15
        if done.any():
            out[left[done]] = h[done]
            a, b, x, c, d, h, left = (v[~done] for v in (a, b, x, c, d, h, left))
            if not left.size:
                break
    out[left] = h
    return out.reshape(shape)


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gammaln(p + q) - gammaln(p) - gammaln(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * _beta_fraction(p, q, y)))
    return np.where(swap, 1 - value, value)


def t_cdf(x, df):
    """Distribution function of Student's t."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def nb_logpmf(y, size, p):
    """log probability of y under a negative binomial with mean size * (1 - p) / p."""
    return gammaln(y + size) - gammaln(size) - gammaln(np.asarray(y, float) + 1) + size * np.log(p) + y * np.log1p(-p)


def nb_cdf(y, size, p):
    return np.where(np.asarray(y) < 0, 0.0, betainc(size, np.maximum(np.asarray(y, float), 0) + 1, p))


def gammainc(a, x):
    """Regularised lower incomplete gamma function P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(-x + a * np.log(x) - gammaln(a))
    steps = int(60 + 12 * np.sqrt(float(np.max(a, initial=1.0))))
    # series below a + 1
    term = np.ones_like(x) / a
    total, low = term.copy(), np.minimum(x, a + 1)
    for n in range(1, steps):
        term = term * low / (a + n)
        total = total + term
    # continued fraction above
    high = np.maximum(x, a + 1)
    b = high + 1 - a
    c, d = np.full_like(high, 1 / _TINY), 1 / b
    h = d.copy()
    for i in range(1, steps):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def gammaincinv(a, u):
    """x with P(a, x) = u: a start from the cube-root normal or the power law, then Halley steps."""
    a, u = np.broadcast_arrays(np.asarray(a, float), np.asarray(u, float))
    t = np.sqrt(-2 * np.log(np.where(u < 0.5, u, 1 - u)))
    z = t - (2.30753 + t * 0.27061) / (1 + t * (0.99229 + t * 0.04481))
    z = np.where(u < 0.5, -z, z)
    cube = a * np.maximum(1e-3, 1 - 1 / (9 * a) + z / (3 * np.sqrt(a))) ** 3
    k = 1 - a * (0.253 + a * 0.12)
    small = np.where(u < k, (u / np.maximum(k, 1e-12)) ** (1 / a), 1 - np.log(np.maximum(1e-12, 1 - (u - k) / np.maximum(1 - k, 1e-12))))
    x = np.where(a > 1, cube, small)
    for _ in range(10):
        error = gammainc(a, x) - u
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            density = np.exp(-x + (a - 1) * np.log(x) - gammaln(a))
            step = error / density
            step = step / (1 - 0.5 * np.minimum(1.0, step * ((a - 1) / x - 1)))
        x = np.where(np.isfinite(step), np.where(x - step <= 0, x / 2, x - step), x)
    return x
