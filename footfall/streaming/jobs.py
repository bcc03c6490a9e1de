"""The operators as Structured Streaming plans.

Event time comes with a watermark; windows, sessions and dedup keep bounded
state that the watermark evicts.  Rows that arrive more than the job's delay
after their event time are split off before the windows (``on_time`` /
``late_rows``): a micro-batch holds rows received after those of earlier ones,
so the watermark can never have passed a row whose lag is at most the delay,
and nothing is dropped unseen.  Operators whose answer depends on the order of
a key's rows (consent, content on screen, recent frames, held frames) go
through ``ordered``: rows wait for the watermark and are released in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators import context as CX
from footfall.operators.governance import filter_live
from footfall.operators.graph import PURCHASE_INTENT
from footfall.sources import lookups as L
from footfall.streaming import ordered as O


#: Groups that the users or devices of an ordered stream are dealt over by hash.
BUCKETS = 32


# ------------------------------------------------------------------ late rows
def _lag_s(delay: str) -> Column:
    n, unit = delay.split()
    return F.lit(int(n) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1_000_000)


def on_time(df: DataFrame, delay: str, ts: str = "ts", ingest: str = "ingest_ts") -> DataFrame:
    """Rows received at most ``delay`` after their event time (a null receipt
    time counts as on time)."""
    return df.where(F.coalesce(F.unix_micros(F.col(ingest)) - F.unix_micros(F.col(ts)) <= _lag_s(delay), F.lit(True)))


def late_rows(df: DataFrame, delay: str, ts: str = "ts", ingest: str = "ingest_ts") -> DataFrame:
    """The other side of :func:`on_time`: together they are all rows."""
    return df.where(~F.coalesce(F.unix_micros(F.col(ingest)) - F.unix_micros(F.col(ts)) <= _lag_s(delay), F.lit(True)))


# ------------------------------------------------------------------ T1
def stream_dedup(df: DataFrame, key: str = "event_id", ts: str = "ingest_ts", delay: str = "10 minutes") -> DataFrame:
    """Exactly one row per id among copies arriving within ``delay`` of
    each other (state is evicted by the watermark)."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# ------------------------------------------------------------------ T2
def stream_tumbling(df: DataFrame, every: str = "5 seconds", key: str = "billboard_id", ts: str = "ts",
                    delay: str = "30 seconds") -> DataFrame:
    """Per billboard and tumbling window: frames, people, peak crowd and
    the last frame's crowd (the context snapshot of X11)."""
    return df.withWatermark(ts, delay).groupBy(key, F.window(ts, every).alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("total_people").alias("people"),
        F.max("cluster_count").alias("peak_crowd"),
        F.max_by("cluster_count", F.struct(F.col(ts), F.col("frame_id"))).alias("last_crowd"))


# ------------------------------------------------------------------ T3
def stream_sliding(df: DataFrame, kind: str, key: str = "billboard_id", ts: str = "ts", compat: bool = False,
                   delay: str = "2 minutes") -> DataFrame:
    """X7 history rows for one window kind, continuously (one
    aggregation: per-direction counts and first appearances are
    conditional aggregates, the mode is a projection after it)."""
    return CX.rolling_history(df.withWatermark(ts, delay), kind, key=key, ts=ts, compat=compat)


# ------------------------------------------------------------------ T4
def stream_sessions(df: DataFrame, gap: str = "30 minutes", key: str = "uuid", ts: str = "ts",
                    delay: str = "1 hour") -> DataFrame:
    """T4: inactivity sessions with ``session_window``."""
    return df.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("events"))


# ------------------------------------------------------------------ T5
def consent_intervals(consent_log: DataFrame) -> DataFrame:
    """Validity intervals [from, to) of each user's consent state (a lead
    over the user's change log — a log, not the event stream)."""
    from pyspark.sql.window import Window
    w = Window.partitionBy("uuid").orderBy("ts")
    return consent_log.select("uuid", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"),
                              F.col("change").alias("state"))


def stream_consent(events: DataFrame, consent_log: DataFrame) -> DataFrame:
    """T5: consent as-of for a stream against the (static) consent log:
    stream–static left join on the user with the interval condition
    (stateless); events outside every opt-out interval pass."""
    iv = consent_intervals(consent_log).where(F.col("state") == "opt_out")
    cond = (F.col("uuid") == F.col("_u")) & (F.col("ts") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    j = events.join(iv.withColumnRenamed("uuid", "_u"), cond, "left")
    return j.where(F.col("_u").isNull()).drop("_u", "valid_from", "valid_to", "state")


def stream_consent_both(events: DataFrame, changes: DataFrame, delay: str = "3 hours", salts: int = 8,
                        id_col: str = "event_id") -> tuple[DataFrame, str]:
    """T5 with both sides streaming: (decided, event schema).

    ``changes``: uuid, ts, change.  Events wait until the watermark (of both
    feeds together) has passed them, so a change that arrives later but within
    ``delay`` still takes effect; a change at an event's own time counts for
    it.  ``decided`` has a row per event: key, ts_us, id, payload (the event as
    JSON), extra (the consent in force, null: never changed) and ``late``
    (arrived behind the watermark, undecided).  A user's events are dealt over
    ``salts`` sub-keys."""
    ev = events.select(F.col("uuid").alias("key"), "ts", F.lit(1).alias("kind"), F.col(id_col).cast("string").alias("id"),
                       O.packed(events).alias("payload"))
    ch = changes.select(F.col("uuid").alias("key"), "ts", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"),
                        F.col("change").alias("payload"))
    return O.in_order(ev.unionByName(ch), O.LastMark(), delay, salts, BUCKETS), events.schema.simpleString()


def consented(decided: DataFrame, schema: str) -> DataFrame:
    """The events that may be used, as they came."""
    kept = decided.where(~F.col("late") & F.col("id").isNotNull() & (F.coalesce("extra", F.lit("opt_in")) != "opt_out"))
    return kept.select(F.from_json("payload", schema, O.JSON_TIME).alias("e")).select("e.*")


# ------------------------------------------------------------------ T6
def stream_current_content(df: DataFrame, delay: str = "3 hours", salts: int = 8) -> DataFrame:
    """J8 continuously, in event-time order: event_id, device_id,
    current_content, late.  A ``content_start`` that arrives late, but within
    ``delay``, counts for the interactions after it; an interaction behind the
    watermark comes out with ``late`` and no content.  Late marks are put out too
    (once per sub-key), other event types are not needed."""
    kind = F.when(F.col("event_type").isin("content_start", "content_end"), 0).when(F.col("event_type") == "interaction", 1)
    rows = df.withColumn("kind", kind).where("kind is not null").select(
        F.col("device_id").alias("key"), "ts", "kind", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"),
        F.when(F.col("event_type") == "content_start", F.col("content_id").cast("string")).alias("payload"))
    out = O.in_order(rows, O.LastMark(), delay, salts, BUCKETS)
    return out.select(F.col("id").cast("bigint").cast("string").alias("event_id"), F.col("key").alias("device_id"),
                      F.col("extra").alias("current_content"), "late")


# ------------------------------------------------------------------ T7
def stream_ttl(df: DataFrame, as_of: Column) -> DataFrame:
    """TTL expiry on the stream (stateless filter, same rule as P6)."""
    return filter_live(df, as_of)


def stream_retention(frames: DataFrame, modes: DataFrame, delay: str = "30 seconds", salts: int = 8) -> DataFrame:
    """T7 with held state, P7 continuously: the log of what a billboard holds.

    A row ``hold`` per frame (its mode as of its time), and once ``expire`` at
    its time plus the mode's retention or ``clear`` when the mode turns strict;
    with that row the frame leaves the state.  ``modes``: billboard_id, ts,
    mode, frame_id.  Columns billboard_id, frame_id, mode, action, at_us, late
    (a late row's action is null)."""
    ev = frames.select(F.col("billboard_id").alias("key"), "ts", F.lit(1).alias("kind"),
                       F.lpad(F.col("frame_id").cast("string"), 20, "0").alias("id"), F.lit(None).cast("string").alias("payload"))
    ch = modes.select(F.col("billboard_id").alias("key"), "ts", F.lit(0).alias("kind"),
                      F.lpad(F.col("frame_id").cast("string"), 20, "0").alias("id"), F.col("mode").alias("payload"))
    held = O.Retained(dict(L.PRIVACY_RETENTION_S), "strict", "strict")
    out = O.in_order(ev.unionByName(ch), held, delay, salts)
    return out.select(F.col("key").alias("billboard_id"), F.col("id").cast("bigint").alias("frame_id"),
                      F.col("payload").alias("mode"), F.col("extra").alias("action"), F.col("ts_us").alias("at_us"), "late")


# ------------------------------------------------------------------ T8
def _frame_rows(frames: DataFrame, text: bool = True) -> DataFrame:
    """Frames as ordered rows, their metrics as JSON or (without ``text``) as a struct."""
    metrics = [F.col(m).cast("double").alias(m) if m != "flow_direction" else F.col(m) for m in CX.METRICS]
    item = F.to_json(F.struct(*metrics), {"ignoreNullFields": "false"}) if text else F.struct(*metrics)
    return frames.select(F.col("billboard_id").alias("key"), "ts", F.lit(1).alias("kind"),
                         F.lpad(F.col("frame_id").cast("string"), 20, "0").alias("id"), item.alias("payload"))


def _figures(out: DataFrame, keep: list[str]) -> DataFrame:
    """X2–X6 from the window figures that came with ordered rows; late rows have none."""
    own = [F.col("key").alias("billboard_id"), F.col("id").cast("bigint").alias("frame_id"), *keep]
    got = out.select(*own, F.from_json("extra", O.FIGURES).alias("f"))
    ctx = CX.context_of(got.select("billboard_id", "frame_id", *keep, *[F.col(f"f{c.replace('_', '.', 1)}").alias(c) for c in CX.STATE]))
    names = ["billboard_id", "frame_id", *keep]
    return ctx.select(*names, *[F.when(~F.col("late"), F.col(c)).alias(c) for c in ctx.columns if c not in names])


def stream_recent_context(frames: DataFrame, delay: str = "1 minute", salts: int = 8) -> DataFrame:
    """X1–X6 per frame, in event-time order.  The state is the last 100
    frames of at most 30 s; the figures are those of the batch form
    (``operators.context``).  A billboard's time is dealt over ``salts`` tasks in
    stretches of 2 minutes.  A frame behind the watermark comes out with
    ``late`` and no figures."""
    out = O.in_order(_frame_rows(frames), O.Recent(100, 30_000_000), delay, salts, stretch_us=120_000_000, reach_us=30_000_000)
    return _figures(out, ["ts_us", "late"])


def stream_context_snapshot(frames: DataFrame, every_s: int = 5, delay: str = "1 minute", quiet_s: int = 3600) -> DataFrame:
    """X11 on a stream: the context of each billboard at the end of every tick
    (``tick_us``), put out by a timer when the watermark has passed it.  A tick
    without a frame repeats the last context (``repeated``), until ``quiet_s``
    after the last frame.  Late frames come out with ``late`` and no figures.
    Only the last 100 frames of a tick are shuffled and held one by one: no
    window that ends at a tick's last frame holds others."""
    ticks = O.Ticks(100, 30_000_000, every_s * 1_000_000, quiet_s * 1_000_000)
    out = O.in_order(_frame_rows(frames, text=False), ticks, delay, newest=(ticks.most, ticks.every_us))
    out = out.withColumn("tick_us", F.col("ts_us")).withColumn("repeated", F.coalesce(F.col("payload") == "repeated", F.lit(False)))
    return _figures(out, ["tick_us", "repeated", "late"])


def stream_intent_trigger(events: DataFrame, threshold: float = 3.0, window_days: int = 7, delay: str = "3 hours",
                          weights: dict[str, float] | None = None, rule: str = "high_purchase_intent") -> DataFrame:
    """G7 on a stream: event_id, uuid, ts_us, trailing_weight, rule, late; a row
    only where a user's trailing weight crosses the threshold (and for events
    behind the watermark, marked late).  The state per user is what is left of
    the last ``window_days`` days."""
    wmap = weights or PURCHASE_INTENT
    weight = F.element_at(F.create_map(*[x for k, v in wmap.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    rows = events.where(F.col("event_type").isin(list(wmap))).select(
        F.col("uuid").alias("key"), "ts", F.lit(1).alias("kind"), F.col("event_id").alias("id"), weight.cast("string").alias("payload"))
    out = O.in_order(rows, O.Crossing(window_days * 86_400_000_000, threshold), delay, buckets=4 * BUCKETS)
    return out.select(F.col("id").alias("event_id"), F.col("key").alias("uuid"), "ts_us",
                      F.col("extra").cast("double").alias("trailing_weight"), F.lit(rule).alias("rule"), "late")


# ------------------------------------------------------------------ T9, T10
def late_split(main_path: str, late_path: str, delay_s: int = 3600, ts: str = "ts", ingest: str = "ingest_ts"):
    """A ``foreachBatch`` function that routes events arriving more
    than ``delay_s`` after their event time to a side table and the rest to
    the main table, each write idempotent by batch id."""

    def _split(batch: DataFrame, batch_id: int) -> None:
        lag = F.unix_micros(F.col(ingest)) - F.unix_micros(F.col(ts))
        late = F.coalesce(lag > F.lit(delay_s * 1_000_000), F.lit(False))
        batch = batch.persist()
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        batch.where(~late).write.mode("overwrite").parquet(f"{main_path}/batch_id={batch_id}")
        batch.unpersist()

    return _split
