"""Sessions, lifecycle spans, page flow, playback intervals,
completion and the half-step EWMA.

Ordered work inside a user / device / session uses lag and last-value windows
cut into time buckets with a carry-in (``prev_row``, ``next_row``, the buckets of
``sessionize``), so one very active key is still spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.jsmath import exact_sum, truthy_num
from footfall.operators.asof import DEFAULT_BUCKET_US, next_row, prev_row


def session_summary(df: DataFrame, page: Column | None = None) -> DataFrame:
    """Per session id: start, end, duration (``session_end`` carries
    ``session_duration`` ms — used when present, else end − start), depth
    (#events), entry and exit page, platform.  Partial + final aggregate."""
    pg = page if page is not None else F.coalesce(
        *[F.col("context")[k] for k in ("url", "path", "page_url", "screen_name")], F.col("entity_id"))
    order = F.struct(F.col("ts"), F.col("event_id"))
    reported = F.when(F.col("event_type") == "session_end",
                      F.col("context")["session_duration"].try_cast("double"))
    g = df.groupBy("session_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("depth"),
        F.min_by(pg, order).alias("entry_page"), F.max_by(pg, order).alias("exit_page"),
        F.min_by(F.col("platform"), order).alias("platform"), F.min_by(F.col("uuid"), order).alias("uuid"),
        F.max(reported).alias("_reported_ms"),
    )
    span_ms = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(1000.0)
    return g.withColumn("duration_ms", F.coalesce(F.col("_reported_ms"), span_ms)).drop("_reported_ms")


def sessionize(df: DataFrame, gap_s: int = 1800, key: str = "uuid") -> DataFrame:
    """W2 (gap is our parameter): a new session starts when the previous
    event of the user is ``gap_s`` or more earlier (as session windows do).  ``gap_session_id`` =
    user + start micros.

    One pass over (user, time bucket) partitions: a bucket is summed up by its
    first and last time and the last start inside it (plain numbers), which is all
    that the buckets after it need.  Whether a bucket's first row starts a
    session, and which session it goes on with, comes from the summaries before it."""
    gap, us = F.lit(gap_s * 1_000_000), F.unix_micros("ts")
    w = Window.partitionBy(key, "_bkt").orderBy("ts", "event_id")
    b = df.withColumn("_bkt", F.floor(us / F.lit(DEFAULT_BUCKET_US)).cast("bigint")).withColumn("_prev", F.lag(us).over(w))
    wk = Window.partitionBy(key).orderBy("_bkt")
    opened = F.col("_before").isNull() | (F.col("_first") - F.col("_before") >= gap)
    carry = b.groupBy(key, "_bkt").agg(F.min(us).alias("_first"), F.max(us).alias("_last"),
                                       F.max(F.when(us - F.col("_prev") >= gap, us)).alias("_inner")) \
        .withColumn("_before", F.lag("_last").over(wk)) \
        .withColumn("_own", F.coalesce("_inner", F.when(opened, F.col("_first")))) \
        .select(key, "_bkt", "_before",
                F.max("_own").over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    before = F.coalesce("_prev", "_before")
    start = F.when(before.isNull() | (us - before >= gap), us)
    # Starts rise in time order, so the largest so far is the last.
    running = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return b.join(carry, [key, "_bkt"], "left").withColumn("_start", start) \
        .withColumn("gap_session_id", F.concat(F.col(key), F.lit("#"),
                                               F.coalesce(running, F.col("_carry")).cast("string"))) \
        .withColumn("is_session_start", F.col("_start").isNotNull()) \
        .drop("_bkt", "_prev", "_before", "_carry", "_start")


FG = ("app_open", "app_foreground")
BG = ("app_background", "app_terminate")


def foreground_spans(df: DataFrame, key: str = "uuid") -> DataFrame:
    """Foreground spans = app_open/app_foreground -> the next
    app_background/app_terminate.  Repeated states are dropped first (a
    transition only counts when the state changes), so every background
    row closes the span opened by the row before it.  Spans still open at
    the end of the data are not emitted."""
    life = df.where(F.col("event_type").isin(*FG, *BG)).withColumn(
        "_state", F.when(F.col("event_type").isin(*FG), "fg").otherwise("bg"))
    p = prev_row(life, key, "ts", ["ts", "event_id"], ["_state"])
    changes = p.where(F.col("prev__state").isNull() | (F.col("prev__state") != F.col("_state"))).drop("prev__state")
    q = prev_row(changes, key, "ts", ["ts", "event_id"], ["_state", "ts", "event_id"])
    return q.where((F.col("_state") == "bg") & (F.col("prev__state") == "fg")).select(
        F.col(key), F.col("prev_event_id").alias("start_event_id"), F.col("prev_ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        ((F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1000.0)).alias("foreground_ms"))


def page_flow(df: DataFrame, page: Column, session: str = "session_id") -> DataFrame:
    """Page-to-page transitions within a session and the time spent on
    the page left; aggregated per (from, to)."""
    v = df.withColumn("_page", page).where(F.col("_page").isNotNull())
    p = prev_row(v, session, "ts", ["ts", "event_id"], ["_page", "ts"])
    t = p.where(F.col("prev__page").isNotNull()).select(
        F.col("prev__page").alias("from_page"), F.col("_page").alias("to_page"),
        ((F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1000.0)).alias("time_on_page_ms"))
    n = F.count(F.lit(1))
    return t.groupBy("from_page", "to_page").agg(
        n.alias("transitions"), (exact_sum("time_on_page_ms").cast("double") / n).alias("avg_time_on_page_ms"))


def play_intervals(df: DataFrame, device: str = "device_id") -> DataFrame:
    """Each content_start is closed by the next content_end of the
    device; when another start comes first, the interval stays open."""
    se = df.where(F.col("event_type").isin("content_start", "content_end"))
    n = next_row(se, device, "ts", ["ts", "event_id"], ["event_type", "event_id", "ts"])
    j = n.where(F.col("event_type") == "content_start").withColumn("_next_ts", F.col("next_ts")).withColumn("end_event_id", F.col("next_event_id"))
    closed = F.coalesce(F.col("next_event_type") == "content_end", F.lit(False))
    return j.select(
        device, F.col("event_id").alias("start_event_id"), "content_id", F.col("ts").alias("start_ts"),
        F.when(closed, F.col("_next_ts")).alias("end_ts"), F.when(closed, F.col("end_event_id")).alias("end_event_id"),
        F.when(closed, "closed").otherwise("open").alias("status"),
        F.when(closed, (F.unix_micros("_next_ts") - F.unix_micros("ts")) / F.lit(1000.0)).alias("played_ms"))


def completion_rate(actual: Column, planned: Column) -> Column:
    """min(1, actual / planned); NULL when either is NULL or 0 (JS
    truthiness)."""
    a, p = truthy_num(actual), truthy_num(planned)
    return F.when(a.isNotNull() & p.isNotNull(), F.least(F.lit(1.0), a.cast("double") / p.cast("double")))


#: Rows of a block of the half-step average.
EWMA_BLOCK = 64
#: Blocks before a row's own that can reach it: 33 * 64 = 2112 halvings, and no double survives 2098.
EWMA_REACH = 33


def half_ewma(df: DataFrame, key: str | list[str], order: list[str], col: str, out: str = "half_ewma",
              chunk_rows: int = 102_400) -> DataFrame:
    """The client's "average" a <- (a + x) / 2 starting from 0 (not a
    mean), per row; a null counts as 0.  ``order`` starts with the time
    column.  Values must lie below 2^950.

    Over m rows the rule is a <- a * 2^-m + b.  A key's rows are numbered
    without a whole-key window (``global_row_number``) and cut into blocks of
    64.  A row's value is its block's running sum of x_j * 2^j, scaled back,
    plus the carry-in of the blocks before, composed from their b by Horner's
    rule.  After 2112 halvings every double is 0, so 33 blocks carry all there
    is: nothing is cut.  The blocks (one row per 64) are chained in chunks
    with a copy of the last 33 blocks, so no task holds a whole key."""
    from footfall.operators.asof import global_row_number
    keys = [key] if isinstance(key, str) else list(key)
    power = F.element_at(F.array(*[F.lit(2.0 ** i) for i in range(1, EWMA_BLOCK + 1)]), F.col("_pos"))
    g = global_row_number(df, keys, order[0], order) \
        .withColumn("_blk", F.floor((F.col("_rn") - 1) / F.lit(EWMA_BLOCK)).cast("bigint")) \
        .withColumn("_pos", (F.col("_rn") - F.col("_blk") * EWMA_BLOCK).cast("int")) \
        .withColumn("_up", power)
    scaled = F.coalesce(F.col(col).cast("double"), F.lit(0.0)) * F.col("_up")
    per_chunk = max(EWMA_REACH, chunk_rows // EWMA_BLOCK)
    sums = g.groupBy(*keys, "_blk").agg((F.sum(scaled) * F.lit(2.0 ** -(EWMA_BLOCK + 1))).alias("_b"))
    own = sums.withColumn("_chunk", F.floor(F.col("_blk") / F.lit(per_chunk)).cast("bigint")).withColumn("_own", F.lit(True))
    tail = own.where(F.pmod(F.col("_blk"), F.lit(per_chunk)) >= per_chunk - EWMA_REACH) \
        .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_blk")
    carry = F.lit(0.0)
    for p in range(EWMA_REACH, 0, -1):
        carry = carry * F.lit(2.0 ** -EWMA_BLOCK) + F.coalesce(F.lag("_b", p).over(w), F.lit(0.0))
    chained = own.unionByName(tail).withColumn("_carry", carry).where("_own").select(*keys, "_blk", "_carry")
    wr = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    j = g.join(chained, [*keys, "_blk"])
    value = F.sum(scaled).over(wr) / F.col("_up") / F.lit(2.0) + F.col("_carry") / F.col("_up")
    return j.withColumn(out, value).drop("_rn", "_blk", "_pos", "_up", "_carry")


def last_half_ewma(df: DataFrame, key: str | list[str], order: list[str], col: str, out: str = "half_ewma") -> DataFrame:
    """W9 final value per key.  Older rows than the last 2112 weigh nothing in
    a double, so a top-2112 window-group limit (partial before the shuffle)
    feeds the fold; no key is gathered whole."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= EWMA_REACH * EWMA_BLOCK)
    g = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order],
                                                                      F.col(col).cast("double").alias("_v")))).alias("_h"))
    return g.select(*keys, F.aggregate("_h", F.lit(0.0), lambda a, x: (a + F.coalesce(x["_v"], F.lit(0.0))) / 2)
                    .alias(out))
