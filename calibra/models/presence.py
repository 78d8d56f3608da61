"""Reporting probability by hour of day, and how unlikely the present silence is."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

RATE, PRIOR, CLIP = 0.05, 0.5, 1e-4


@dataclass
class PresenceState:
    p: np.ndarray = field(default_factory=lambda: np.full(24, PRIOR))
    log_silent: float = 0.0


def step(st: PresenceState, slot: int, reported: bool) -> tuple[PresenceState, float]:
    """State after a slot, and 1 - probability of a silence as long as the present one."""
    hour = slot // 3600 % 24
    p = float(np.clip(st.p[hour], CLIP, 1 - CLIP))
    log_silent = 0.0 if reported else st.log_silent + float(np.log1p(-p))
    own = st.p.copy()
    own[hour] += RATE * (float(reported) - own[hour])
    return PresenceState(own, log_silent), 0.0 if reported else float(-np.expm1(log_silent))
