"""Helpers shared by the tests."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def ts(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def same_rows(a, b) -> bool:
    return Counter(tuple(norm(x) for x in r) for r in a) == Counter(tuple(norm(x) for x in r) for r in b)
