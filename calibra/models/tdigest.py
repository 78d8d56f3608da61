"""Merging t-digest (scale k1): centroids as (mean, weight) pairs of little-endian doubles."""

from __future__ import annotations

import numpy as np

DELTA = 100.0


def _k(q):
    return DELTA / (2 * np.pi) * np.arcsin(2 * np.clip(q, 0, 1) - 1)


def compress(means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring centroids joined while they span at most one unit of k."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    out_m: list[float] = []
    out_w: list[float] = []
    before = 0.0
    for m, w in zip(means.tolist(), weights.tolist()):
        if out_w and _k((before + out_w[-1] + w) / total) - _k(before / total) <= 1:
            out_m[-1] += (m - out_m[-1]) * w / (out_w[-1] + w)
            out_w[-1] += w
        else:
            before += out_w[-1] if out_w else 0.0
            out_m.append(m)
            out_w.append(w)
    return np.array(out_m), np.array(out_w)


def to_bytes(means: np.ndarray, weights: np.ndarray) -> bytes:
    return np.stack([means, weights], axis=1).astype("<f8").tobytes()


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(data, "<f8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def build(values: np.ndarray) -> bytes:
    return to_bytes(*compress(np.asarray(values, float), np.ones(len(values)))) if len(values) else b""


def merge(parts: list[bytes]) -> bytes:
    pairs = [from_bytes(p) for p in parts if p]
    return to_bytes(*compress(np.concatenate([m for m, _ in pairs]), np.concatenate([w for _, w in pairs]))) if pairs else b""


def quantile(data: bytes, q: float) -> float:
    """Linear between the centres of the centroids."""
    means, weights = from_bytes(data)
    if not len(means):
        return float("nan")
    centres = (np.cumsum(weights) - weights / 2) / weights.sum()
    return float(np.interp(q, centres, means))


def cdf(data: bytes, x: float) -> float:
    means, weights = from_bytes(data)
    if not len(means):
        return float("nan")
    centres = (np.cumsum(weights) - weights / 2) / weights.sum()
    return 0.0 if x < means[0] else 1.0 if x > means[-1] else float(np.interp(x, means, centres))
