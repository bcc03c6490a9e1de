"""Whitening of embeddings.

The distinct integer vectors are fitted: their sums, then the scatter of the
centred vectors (each task adds up its own, Spark adds the tasks').  Only the
d x d scatter comes to the driver.  There a pivoted Cholesky factorisation
gives scatter = L L' with independent columns, and one-sided Jacobi rotations
on L itself make the columns orthogonal: their squared norms over n are the
eigenvalues, the normalised columns the components.  No second product is
formed, so small eigenvalues keep their digits.

Centring is exact: n * x - S is an integer, rounded once when it becomes a
double, so a large common offset costs nothing.

Defined cases.  Rows whose vector is null or holds a null, NaN or infinite
entry are left out, and so are entries of 2^53 / 64 or more, which no exact
integer can carry on, and vectors of another length than most (the longer
length where two are as frequent; empty vectors are no length).  A null or
repeated vec_id is a row like any other.  Only components of a variance above
rounding are given, so equal vectors, one vector or an empty table give no
rows.  ``deviation`` is null where the exact number does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_LIMIT = float(2**53)


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with x = floor(64 * c) + 1000000 for every usable row of ``vectors`` (vec_id, embedding)."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: SCALE * c.cast("double")).alias("v"))
    # NaN counts as larger than any number, null makes the comparison null: both fail.
    usable = (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < _LIMIT, F.lit(False)))
    wide = wide.filter(F.col("v").isNotNull() & usable)
    commonest = wide.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d"))
    rows = wide.filter(F.size("v") == commonest.scalar())
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c) + F.lit(OFFSET).cast("long")).alias("x"))


def matrix_of(column) -> np.ndarray:
    """An Arrow list column of one length as an n x d matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs where they are sure to fit, else Python integers."""
    s = np.array(sums, dtype=object)
    most = max(n * int(np.abs(x).max(initial=0)), max(abs(v) for v in sums))
    if most < 2**61:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def squared_length(dev: np.ndarray) -> list[int | None]:
    """Sum of squares per row, exactly; None where it does not fit a long."""
    if dev.dtype != object and dev.shape[1] * int(np.abs(dev).max(initial=0)) ** 2 < 2**62:
        return (dev * dev).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in (dev.astype(object) ** 2).sum(axis=1)]


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                part = x.sum(axis=0, dtype=object) if np.abs(x).max() * len(x) >= 2**62 else x.sum(axis=0)
                n, total = n + len(x), part.astype(object) if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array([-1, *range(len(total))], pa.int32()), "s": pa.array([str(v) for v in [n, *total]])})

    rows = fit.select("x").mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r.i: int(r.s) for r in rows}
    return found.pop(-1, 0), [found[i] for i in range(len(found))]


def _products(fit: DataFrame, image) -> np.ndarray:
    """The sum over all rows of ``image(x)' image(x)``: per task, then by Spark."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                y = image(matrix_of(batch.column(0)))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.tril_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    rows = fit.select("x").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((r.i for r in rows), default=-1)
    out = np.zeros((d, d))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L (d x rank, rows in the given order) with L L' = scatter, the largest remaining diagonal first.

    It ends when no remaining diagonal is above rounding of the largest one.
    """
    d = len(scatter)
    left, factor = np.diag(scatter).astype(float).copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.max(initial=0), 0)
    done = np.zeros(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if left[p] <= least:
            return factor[:, :k]
        done[p] = True
        column = (scatter[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[done] = np.where(np.arange(d)[done] == p, np.sqrt(left[p]), 0.0)
        factor[:, k] = column
        left -= column**2
    return factor


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: rotates columns of ``factor`` until every two are orthogonal to rounding.

    Each round of the tournament order turns d / 2 disjoint pairs at once.
    """
    a = factor.copy()
    if a.shape[1] % 2:
        a = np.hstack([a, np.zeros((len(a), 1))])
    m = a.shape[1]
    tolerance = max(4.0, np.sqrt(len(a))) * np.finfo(float).eps
    order = np.arange(m)
    for _ in range(sweeps):
        turned = 0
        for _ in range(m - 1):
            p, q = order[: m // 2], order[m // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(xy) > tolerance * np.sqrt(xx) * np.sqrt(yy)
            turned += int(off.sum())
            safe = np.where(off, xy, 1.0)
            zeta = (yy - xx) / (2 * safe)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(off, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * (x - t * y), c * (y + t * x)
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    return a


def principal_axes(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of scatter / n, falling, and the unit components as columns.

    Columns of a squared norm within rounding of the largest one's are no components.
    """
    turned = orthogonal_columns(pivoted_cholesky(scatter))
    norms = np.sqrt((turned**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] ** 2 > len(scatter) * np.finfo(float).eps * (norms.max(initial=0) ** 2)]
    return norms[order] ** 2 / n, turned[:, order] / norms[order]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component (at most ``components``, fewer where fewer vary):
    vec_id, component, n, deviation, whitened, explained, identity_error.
    """
    rows = integer_rows(vectors)
    fit = materialize(rows.select("x").distinct(), "whiten")
    n, sums = _sums(fit)
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], names)
    scatter = _products(fit, lambda x: (deviations(x, n, sums) / n).astype(float))
    values, axes = principal_axes(scatter, n)
    values, axes, total = values[:components], axes[:, :components], float(np.trace(scatter)) / n
    k, turn = len(values), axes / np.sqrt(values)
    # The deviations add up to zero exactly, so the projections are centred as they are.
    measured = _products(fit, lambda x: (deviations(x, n, sums) / n).astype(float) @ turn) if k else np.zeros((0, 0))
    error = float(np.abs(measured / n - np.eye(k)).max(initial=0))
    shares = values / total if k else values

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows or not k:
                continue
            dev = deviations(matrix_of(batch.column(1)), n, sums)
            m, at = len(dev), np.repeat(np.arange(len(dev)), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(at)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                "n": np.full(m * k, n, np.int64), "deviation": pa.array(squared_length(dev), pa.int64()).take(pa.array(at)),
                "whitened": ((dev / n).astype(float) @ turn).ravel(), "explained": np.tile(shares, m), "identity_error": np.full(m * k, error),
            })

    return rows.mapInArrow(project, names)
