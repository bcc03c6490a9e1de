"""One as-of helper shared by consent (J1), geo (J5), content (J8),
weather (J9), attribution (G12) and privacy modes (P7/P8).

"For every row, the last non-null value of some columns among the rows of
the same key ordered at or before it."  A plain ``last(ignorenulls)``
window over ``partitionBy(key)`` puts all rows of a key in one task, so a
key holding a third of the data would run in one task.  Here the window is
cut into (key, time bucket) partitions and each bucket receives a carry-in
— the last value from earlier buckets — computed from a per-bucket summary
(one row per active key-bucket, a partial aggregate).  The per-row window
and the carry-in join share the (key, bucket) distribution, so there is one
shuffle for the rows.  A bucket is one task's work and AQE does not split it
(the window needs it whole): for a key that holds very many rows an hour, give
a smaller ``bucket_us``.  The result does not depend on it.

With ``max_age_us`` the bucket is the age limit, so only the previous
bucket can hold a usable value and the carry-in is a plain shift by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_BUCKET_US = 3600 * 1_000_000


def asof_last(
    df: DataFrame,
    key: str | list[str],
    ts: str,
    order: list[str | Column],
    values: dict[str, Column],
    bucket_us: int = DEFAULT_BUCKET_US,
    max_age_us: int | None = None,
) -> DataFrame:
    """Add, for each name in ``values``, the last non-null value of that
    expression among rows of the same key with order ``<=`` the row's own,
    plus ``{name}_ts`` (TIMESTAMP of that row).

    ``ts`` is a TIMESTAMP column; ``order`` is the full ordering (it should
    start with ``ts`` and end in a unique tie-breaker).  With
    ``max_age_us``, values older than that are dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    width = max_age_us if max_age_us is not None else bucket_us
    ord_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    b = df.withColumn("_bkt", F.floor(F.unix_micros(F.col(ts)) / F.lit(width)).cast("bigint")) \
        .withColumn("_ord", ord_struct)
    tagged = {n: F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(ts).alias("t"))) for n, v in values.items()}
    for n, v in tagged.items():
        b = b.withColumn(f"_val_{n}", v)

    # per (key, bucket): the last non-null tagged value — a partial aggregate
    summary = b.groupBy(*keys, "_bkt").agg(
        *[F.max_by(F.col(f"_val_{n}"), F.when(F.col(f"_val_{n}").isNotNull(), F.col("_ord"))).alias(f"_last_{n}")
          for n in values]
    )
    if max_age_us is not None:
        carry = summary.select(*keys, (F.col("_bkt") + 1).alias("_bkt"),
                               *[F.col(f"_last_{n}").alias(f"_carry_{n}") for n in values])
    else:
        wk = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(
            *keys, "_bkt", *[F.last(F.col(f"_last_{n}"), ignorenulls=True).over(wk).alias(f"_carry_{n}")
                             for n in values]
        )
    joined = b.join(carry, [*keys, "_bkt"], "left")
    wr = Window.partitionBy(*keys, "_bkt").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for n in values:
        got = F.coalesce(F.last(F.col(f"_val_{n}"), ignorenulls=True).over(wr), F.col(f"_carry_{n}"))
        out = out.withColumn(f"_got_{n}", got)
        fresh = F.lit(True) if max_age_us is None else (
            F.unix_micros(F.col(ts)) - F.unix_micros(F.col(f"_got_{n}.t")) <= F.lit(max_age_us))
        out = out.withColumn(n, F.when(fresh, F.col(f"_got_{n}.v"))) \
            .withColumn(f"{n}_ts", F.when(fresh, F.col(f"_got_{n}.t")))
    drop = ["_bkt", "_ord"] + [c for n in values for c in (f"_val_{n}", f"_carry_{n}", f"_got_{n}")]
    return out.drop(*drop)


def prev_row(df: DataFrame, key: str | list[str], ts: str, order: list[str], cols: list[str],
             bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``lag`` by one row within a key, without putting the whole key in
    one window partition: the lag runs inside (key, time bucket) and the
    first row of a bucket takes the last row of the previous non-empty
    bucket from a per-bucket summary.  Adds ``prev_{c}`` for each column
    (NULL for the key's first row)."""
    keys = [key] if isinstance(key, str) else list(key)
    b = df.withColumn("_bkt", F.floor(F.unix_micros(F.col(ts)) / F.lit(bucket_us)).cast("bigint"))
    ord_struct = F.struct(*[F.col(o) for o in order])
    summary = b.groupBy(*keys, "_bkt").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ord_struct).alias("_last"))
    wk = Window.partitionBy(*keys).orderBy("_bkt")
    carry = summary.select(*keys, "_bkt", F.lag("_last").over(wk).alias("_carry"))
    j = b.join(carry, [*keys, "_bkt"], "left")
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    rn = F.row_number().over(w)
    for c in cols:
        j = j.withColumn(f"prev_{c}", F.when(rn == 1, F.col("_carry")[c]).otherwise(F.lag(F.col(c)).over(w)))
    return j.drop("_bkt", "_carry")


def next_row(df: DataFrame, key: str | list[str], ts: str, order: list[str], cols: list[str],
             bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``lead`` by one row within a key, bucketed like :func:`prev_row`:
    the last row of a bucket takes the first row of the next non-empty
    bucket.  Adds ``next_{c}``."""
    keys = [key] if isinstance(key, str) else list(key)
    b = df.withColumn("_bkt", F.floor(F.unix_micros(F.col(ts)) / F.lit(bucket_us)).cast("bigint"))
    ord_struct = F.struct(*[F.col(o) for o in order])
    summary = b.groupBy(*keys, "_bkt").agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ord_struct).alias("_first"))
    wk = Window.partitionBy(*keys).orderBy("_bkt")
    carry = summary.select(*keys, "_bkt", F.lead("_first").over(wk).alias("_carry"))
    j = b.join(carry, [*keys, "_bkt"], "left")
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    nxt_exists = F.lead(F.lit(1)).over(w).isNotNull()
    for c in cols:
        j = j.withColumn(f"next_{c}", F.when(nxt_exists, F.lead(F.col(c)).over(w)).otherwise(F.col("_carry")[c]))
    return j.drop("_bkt", "_carry")


def chunked_range(df: DataFrame, key: str | list[str], ts: str, horizon_us: int, chunk_us: int,
                  columns: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Range-window aggregates over ``(ts - horizon, ts]`` per key, with
    the key cut into time chunks: every chunk gets a read-only copy of the
    previous chunk's last ``horizon`` of rows, so each row sees exactly the
    rows a global range window would, while a hot key is spread over
    ``span / chunk`` window partitions.  ``columns`` maps output names to
    window-aggregate builders ``f(window_spec) -> Column``."""
    keys = [key] if isinstance(key, str) else list(key)
    us = F.unix_micros(F.col(ts))
    chunk = F.floor(us / F.lit(chunk_us)).cast("bigint")
    own = df.withColumn("_chunk", chunk).withColumn("_own", F.lit(True))
    tail = df.where(us - F.floor(us / F.lit(chunk_us)) * F.lit(chunk_us) >= F.lit(chunk_us - horizon_us)) \
        .withColumn("_chunk", chunk + 1).withColumn("_own", F.lit(False))
    u = own.unionByName(tail).withColumn("_us", us)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(-horizon_us + 1, 0)
    out = u.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return out.where("_own").drop("_own", "_chunk", "_us")


def global_row_number(df: DataFrame, key: str | list[str], ts: str, order: list[str],
                      bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``row_number()`` over the whole key in ``order`` (which must start
    with the time column ``ts``), computed without a whole-key window: a
    row's number is its number inside (key, time bucket) plus the count of
    the key's rows in earlier buckets (a cumulative sum over the per-bucket
    counts, one row per active bucket).  Adds ``_rn``."""
    keys = [key] if isinstance(key, str) else list(key)
    b = df.withColumn("_bkt", F.floor(F.unix_micros(F.col(ts)) / F.lit(bucket_us)).cast("bigint"))
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    wk = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_bkt", F.coalesce(F.sum("_c").over(wk), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return b.join(offs, [*keys, "_bkt"]).withColumn("_rn", F.row_number().over(w) + F.col("_off")) \
        .drop("_bkt", "_off")
