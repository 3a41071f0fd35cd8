"""Checks of numeric parameters before any work starts."""

from __future__ import annotations

import math


def finite(name: str, x: float) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ValueError(f"{name} must be a finite number: {x!r}")
    return float(x)


def positive(name: str, x: int) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 1:
        raise ValueError(f"{name} must be a whole number of at least 1: {x!r}")
    return x


def share(name: str, x: float) -> float:
    if not 0 <= finite(name, x) <= 1:
        raise ValueError(f"{name} must lie between 0 and 1: {x!r}")
    return float(x)
