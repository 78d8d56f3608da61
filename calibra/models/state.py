"""Stored model states: a version, then plain numbers, so that no class is needed to read one.

A state that another version wrote, or that is cut off, raises Unreadable; its series starts
cold. States are caches: the archive of scores is the record.
"""

from __future__ import annotations

import struct

import numpy as np

from calibra.models import continuous, count

#: Version that reads and writes the states of each flavor.
VERSIONS = {"continuous": continuous.VERSION, "count": count.VERSION}
_POINT = struct.Struct("<HHddqq")
_COUNT = struct.Struct("<HHqd")


class Unreadable(ValueError):
    """A stored state that this version can't continue."""


def _numbers(blob: bytes, at: int, wanted: int) -> np.ndarray:
    if len(blob) != at + 8 * wanted:
        raise Unreadable(f"{len(blob)} bytes instead of {at + 8 * wanted}")
    return np.frombuffer(blob, np.float64, wanted, at).copy()


def _head(form: struct.Struct, blob: bytes | None, version: int) -> tuple:
    if blob is None or len(blob) < form.size:
        raise Unreadable("no state" if blob is None else "cut off")
    found = form.unpack_from(blob)
    if found[0] != version:
        raise Unreadable(f"version {found[0]} instead of {version}")
    return found


def point_bytes(st: continuous.ContinuousState) -> bytes:
    k = len(st.x)
    return _POINT.pack(continuous.VERSION, k, st.s, st.n, st.t0, st.last) + st.x.astype(np.float64).tobytes() + st.p.astype(np.float64).tobytes()


def point_state(blob: bytes | None, par: continuous.ContinuousParams) -> continuous.ContinuousState:
    """The state; one whose design isn't that of the parameters is unreadable."""
    _, k, s, n, t0, last = _head(_POINT, blob, continuous.VERSION)
    if k not in (0, 2 + 2 * len(par.periods) * par.n_harmonics):
        raise Unreadable(f"{k} coefficients")
    numbers = _numbers(blob, _POINT.size, k + k * k)
    return continuous.ContinuousState(numbers[:k], numbers[k:].reshape(k, k), s, n, t0, last)


def count_bytes(bank: count.CountBank, i: int = 0, last: int = -1) -> bytes:
    """State of one series of a bank; last: the start of its last window."""
    k = bank.a.shape[1]
    parts = (bank.a[i], bank.b[i], bank.logw[i], bank.hours[i], bank.days[i])
    return _COUNT.pack(count.VERSION, k, int(bank.windows[i]), float(last)) + b"".join(np.ascontiguousarray(x, np.float64).tobytes() for x in parts)


def count_state(blob: bytes | None, par: count.CountParams) -> tuple[count.CountBank, int]:
    """(a bank of the one series, start of its last window; -1 before the first)."""
    _, k, windows, last = _head(_COUNT, blob, count.VERSION)
    if k != len(count.SIZES):
        raise Unreadable(f"{k} sizes")
    numbers = _numbers(blob, _COUNT.size, 3 * k + 31)
    bank = count.CountBank(1, par)
    bank.a, bank.b, bank.logw = (numbers[None, i * k : (i + 1) * k] for i in range(3))
    bank.hours, bank.days = numbers[None, 3 * k : 3 * k + 24], numbers[None, 3 * k + 24 :]
    bank.windows[:] = windows
    return bank, int(last)
