"""Numeric semantics of the client code, expressed as Catalyst expressions.

* ``Math.round`` is ``floor(x + 0.5)`` (half up, also for negatives), not
  Spark's half-away-from-zero ``round``.
* JS truthiness: ``''``, ``0``, ``NaN``, ``null`` are all false, so
  "first truthy of a, b, c" is ``coalesce(nullif(a, ''), ...)``.
* ANSI mode raises on ``/0``: every ratio goes through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def js_round(x) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5) as BIGINT."""
    return F.floor(_c(x) + F.lit(0.5)).cast("bigint")


def truthy_str(x) -> Column:
    """String value, or NULL when it is JS-falsy (NULL or empty)."""
    c = _c(x)
    return F.when(c != F.lit(""), c)


def truthy_num(x) -> Column:
    """Numeric value, or NULL when it is JS-falsy (NULL, 0 or NaN)."""
    c = _c(x)
    return F.when((c != F.lit(0)) & ~F.isnan(c.cast("double")), c)


def safe_div(a, b) -> Column:
    """a / b as DOUBLE, NULL when b is 0 or NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def round6(x) -> Column:
    """Doubles are compared across engines at 6 decimals.

    Rounds ``x * 1e6`` half away from zero and scales back — the same
    double arithmetic DuckDB's ``round(x, 6)`` performs, so a value lying
    on a rounding tie lands on the same side in both engines."""
    return F.round(_c(x).cast("double") * F.lit(1e6), 0) / F.lit(1e6)


def exact_sum(x) -> Column:
    """Order-independent sum: accumulate in DECIMAL(38,12) (exact for the
    decimal inputs of the data), so partial sums combined in any order give
    the same total; cast back to DOUBLE by the caller."""
    return F.sum(_c(x).cast("decimal(38,12)"))


def q9(x) -> Column:
    """``x`` quantised to 1e-9 as a BIGINT (x · 1e9 rounded half away from
    zero)."""
    return F.round(_c(x).cast("double") * F.lit(1e9), 0).cast("bigint")


def qsum9(x) -> Column:
    """Exact, order-independent sum on primitive longs for bounded metrics
    (|Σx| < 9e9): Σ q9(x).  Divide by 1e9 for the value.  Faster than a
    DECIMAL(38, s) sum, which runs on BigDecimal."""
    return F.sum(q9(x))
