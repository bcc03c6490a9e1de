"""Figures of trailing frame windows, in numpy.

A row's window is the rows ``lo`` to ``hi`` of rows in time order, at most a
hundred of them, so every figure is one vector step per place in the window.
Sums run oldest first and squares by Welford's rule, as Spark's window
aggregates do, so the doubles are the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:  # the workers need not have the package
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

SUMMED = ("cluster_count", "avg_density", "dwell_avg", "engagement", "attention")
TRENDED = ("cluster_count", "avg_density", "engagement")


def window_starts(us: np.ndarray, pos: np.ndarray, most: int, horizon_us: int) -> np.ndarray:
    """First place of each row's window; ``pos`` numbers the rows of a part from 1, and no window leaves its part."""
    place = np.arange(len(us))
    begins = np.flatnonzero(pos[1:] == 1) + 1
    shift = np.zeros(len(us), np.int64)
    shift[begins] = us[begins - 1] + horizon_us + 1 - us[begins]  # each part begins out of reach of the one before
    line = us + np.cumsum(shift)
    return np.maximum(np.searchsorted(line, line - horizon_us, side="left"), place - np.minimum(pos, most) + 1)


def _state(x: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    n = hi - lo + 1
    half = n // 2
    zero = np.zeros(len(n))
    s, h1, h2 = ({m: zero.copy() for m in of} for of in (SUMMED, TRENDED, TRENDED))
    mean, squares = ({m: zero.copy() for m in ("cluster_count", "avg_density")} for _ in range(2))
    peak, peak_at = np.full(len(n), -np.inf), lo.copy()
    for j in range(int(n.max(initial=0))):
        live, older = j < n, j < half
        every = bool(live.all())
        k = lo + j if every else np.minimum(lo + j, hi)
        for m in SUMMED:
            v = x[m][k]
            seen = v if every else np.where(live, v, 0.0)
            s[m] += seen
            if m in h1:
                h1[m] += np.where(older, v, 0.0)
                h2[m] += np.where(older, 0.0, seen)
            if m in mean:
                delta = v - mean[m]
                step = delta / (j + 1)
                more = delta * (delta - step)
                mean[m] += step if every else np.where(live, step, 0.0)
                squares[m] += more if every else np.where(live, more, 0.0)
            if m == "cluster_count":
                higher = (v > peak) & live
                peak[higher], peak_at[higher] = v[higher], k[higher]
    out = {"n": n, "peak": peak, "peak_at": peak_at, "ss_cc": squares["cluster_count"] / n * n, "ss_dn": squares["avg_density"] / n * n}
    return out | {f"{name}_{m}": v for name, of in (("s", s), ("h1", h1), ("h2", h2)) for m, v in of.items()}


def trailing_state(x: dict[str, np.ndarray], kind: np.ndarray, label_of: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int = 8192) -> dict[str, np.ndarray]:
    """Size, sums, sums of the older and newer half, squares, peak and its place, the label that most rows have (tie:
    latest first appearance) and the number of kinds; ``kind`` is a code per row, ``label_of`` the label of a kind."""
    parts = [_state(x, lo[a : a + block], hi[a : a + block]) for a in range(0, max(len(lo), 1), block)]
    out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def seen(where):
        at = np.flatnonzero(where)
        first = np.searchsorted(at, lo, side="left")
        return np.searchsorted(at, hi, side="right") - first, np.append(at, 0)[first]

    out["kinds"], out["label"] = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    for c in range(len(label_of)):
        out["kinds"] += seen(kind == c)[0] > 0
    best, labels = np.zeros(len(lo), np.int64), label_of[kind]
    for label in np.unique(label_of):
        count, first = seen(labels == label)
        rank = np.where(count > 0, count * (len(kind) + 1) + first, -1)
        out["label"], best = np.where(rank > best, label, out["label"]), np.maximum(rank, best)
    return out


#: What :func:`with_state` adds to its rows.
STATE = (["n bigint"] + [f"s_{m} double" for m in SUMMED] + [f"h1_{m} double" for m in TRENDED] + [f"h2_{m} double" for m in TRENDED]
         + ["ss_cc double", "ss_dn double", "label bigint", "kinds bigint", "peak double", "peak_us bigint"])


def with_state(names: list[str], label_of: list[int], most: int, horizon_us: int):
    """A function for ``mapInArrow`` over rows sorted by part and time (``_us``, ``_pos`` in the part, ``_kind`` and the
    metrics as ``_m_<name>``): the columns ``names`` of the rows with ``_own``, with the figures as ``_f_<name>``.
    From batch to batch it carries the rows that the next ones can reach."""
    reads = ["_us", "_pos", "_kind", *[f"_m_{m}" for m in SUMMED]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in reads}
            old = 0 if carried is None else len(carried["_us"])
            rows = new if carried is None else {c: np.concatenate([carried[c], new[c]]) for c in reads}
            own = np.flatnonzero(batch.column("_own").to_numpy(zero_copy_only=False))
            pos = rows["_pos"].astype(np.int64)
            # carried rows stand for themselves only, so that nothing before them is asked for
            pos[:old] = np.minimum(pos[:old], np.arange(old) + 1)
            hi = own + old
            lo = window_starts(rows["_us"], pos, most, horizon_us)[hi]
            f = trailing_state({m: rows[f"_m_{m}"] for m in SUMMED}, rows["_kind"], np.array(label_of), lo, hi)
            f["peak_us"] = rows["_us"][f["peak_at"]] if len(hi) else np.zeros(0, np.int64)
            kept = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [kept.column(c) for c in names] + [pa.array(f[c.split()[0]], pa.float64() if c.endswith("double") else pa.int64()) for c in STATE],
                names=[*names, *[f"_f_{c.split()[0]}" for c in STATE]])
            carried = {c: v[max(0, len(v) - most + 1) :] for c, v in rows.items()} if most > 1 else None

    return run
