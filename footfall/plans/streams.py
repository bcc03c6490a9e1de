"""Streaming queries (T1–T10), each checked against its batch twin.

The input is derived from the driver tables and arrives in slices by the time
it was *received*: every tenth event is hours late, so late events lie on both
sides of each border between slices.  Every slice is a micro-batch, and the
stream is stopped and started again from its checkpoint after each.  A far-future
row of a marker key ends the input: it moves the watermark past the data, so
the last windows close and what is held comes out; its own rows never count.
Queries whose job splits late rows off return both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.operators import governance as GV
from footfall.plans import inputs as I
from footfall.plans.context import DUCK_TICKS, duck_recent, frames_on, _HIST_SELECT, duck_history, _hist_out
from footfall.plans.registry import register
from footfall.session import materialize, scratch_path
from footfall.sources import fixtures as fx
from footfall.sources import uploads as UP
from footfall.sources.fixtures import duck_sql
from footfall.streaming import jobs as ST

US = F.unix_micros
MARKER = "~end-of-input"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_slices(spark, name: str, inputs: dict[str, tuple[DataFrame, str]], build, slices: int = 4,
               markers: dict[str, DataFrame] | None = None, foreach=None) -> str:
    """Writes each input in ``slices`` by its receipt column (one border set
    for all, so inputs stay in step), then its marker row; runs
    ``build(streams)`` on one slice of each input per micro-batch, stopped after
    it and resumed from its checkpoint.  A slice is as many files as its tasks
    write.  Returns the sink path (the base path for a ``foreach`` sink)."""
    base = scratch_path(spark, name)
    # written once: the borders and every slice are cut from it
    inputs = {k: (materialize(df, f"{name}-{k}"), c) for k, (df, c) in inputs.items()}
    # as whole numbers: a plan may be cut by any column, also one it goes on with
    spans = [df.agg(F.min(US(c)), F.max(US(c))).first() for df, c in inputs.values()]
    lo, hi = min(x[0] for x in spans if x[0] is not None), max(x[1] for x in spans if x[1] is not None)
    width = (hi - lo) // slices + 1

    def run():
        streams = {k: spark.readStream.schema(df.schema).parquet(f"{base}/in-{k}") for k, (df, _c) in inputs.items()}
        w = build(streams).writeStream.option("checkpointLocation", f"{base}/ck").trigger(availableNow=True)
        q = w.foreachBatch(foreach(base)) if foreach else w.format("parquet").option("path", f"{base}/out").outputMode("append")
        q.start().awaitTermination()

    before = {c: spark.conf.get(c, None) for c in (_STORE, _NO_DATA)}
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        last = slices + (1 if markers else 0) - 1
        for i in range(last + 1):
            for k, (df, c) in inputs.items():
                at = F.floor((US(c) - F.lit(lo)) / F.lit(width))
                part = df.where(at == i) if i < slices else markers.get(k, df.limit(0)).select(*df.columns)
                part.write.mode("append").parquet(f"{base}/in-{k}")
            # what a slice makes ripe comes out with the next one, after the last with a batch of its own
            spark.conf.set(_NO_DATA, str(i == last).lower())
            run()
    finally:
        for c, v in before.items():
            if v is None:
                spark.conf.unset(c)
            else:
                spark.conf.set(c, v)
    return base if foreach else f"{base}/out"


def run_incremental(spark, name: str, batch_df: DataFrame, build, ts: str = "ts", slices: int = 4,
                    marker: DataFrame | None = None, foreach=None) -> str:
    """:func:`run_slices` for one input."""
    return run_slices(spark, name, {"a": (batch_df, ts)}, lambda s: build(s["a"]), slices,
                      {"a": marker} if marker is not None else None, foreach)


def received(df: DataFrame, number: str, late_s: int, out_of_order_s: int) -> DataFrame:
    """Adds ``ingest_ts``: every tenth row is ``late_s`` late, the next one ``out_of_order_s``, others one second."""
    n = F.col(number) % 10
    lag = F.when(n == 0, late_s).when(n == 1, out_of_order_s).otherwise(1)
    return df.withColumn("ingest_ts", F.timestamp_add("SECOND", lag, F.col("ts")))


def _marker_like(df: DataFrame, ts: str, key: str, hours: int = 24) -> DataFrame:
    """One row shaped like ``df`` with the marker key, ``hours`` after the
    last event."""
    last = df.agg(F.max(ts).alias("_m"))
    cols = []
    for f in df.schema.fields:
        if f.name == ts:
            cols.append(F.timestamp_add("HOUR", F.lit(hours), F.col("_m")).alias(ts))
        elif f.name == key:
            cols.append(F.lit(MARKER).cast(f.dataType).alias(key))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return last.select(*cols)


# ------------------------------------------------------------------ T1
@register("stream_dedup", duck_sql(["fx_envelope"], "", """
select event_id, uuid, event_type, ts_us from fx_envelope"""))
def q_stream_dedup(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).select("event_id", "uuid", "event_type", "ts", "ingest_ts", "k")
    dups = env.where(F.col("k") % 7 == 0).withColumn("ingest_ts", F.timestamp_add("SECOND", F.lit(60),
                                                                                  F.col("ingest_ts")))
    both = env.unionByName(dups).drop("k")
    out = run_incremental(spark, "stream-dedup", both, lambda s: ST.stream_dedup(s, "event_id", "ingest_ts"),
                          ts="ingest_ts")
    return spark.read.parquet(out).select("event_id", "uuid", "event_type", US("ts").alias("ts_us"))


# ------------------------------------------------------------------ T2
@register("stream_tumbling", duck_sql(["fx_base", "fx_frame"], "", """
select 'window' as side, billboard_id, (ts_us // 5000000) * 5000000 as window_start_us, count(*) as frames,
  cast(sum(total_people) as bigint) as people,
  max(cluster_count) as peak_crowd, arg_max(cluster_count, {'t': ts_us, 'f': frame_id}) as last_crowd
from fx_frame where frame_id % 10 <> 0 group by billboard_id, ts_us // 5000000
union all select 'late', billboard_id, ts_us, 1, total_people, cluster_count, cluster_count from fx_frame
where frame_id % 10 = 0"""))
def q_stream_tumbling(spark, sf_dir):
    """Frames up to 20 s out of order go to their window, those 5 min late to the late side: both are returned."""
    fr = frames_on(spark, sf_dir, "ts_us").select("billboard_id", "frame_id", "ts", "total_people", "cluster_count")
    fr = received(fr, "frame_id", 300, 20)
    out = run_incremental(spark, "stream-tumbling", fr, lambda s: ST.stream_tumbling(ST.on_time(s, "30 seconds"), "5 seconds"),
                          ts="ingest_ts", marker=_marker_like(fr, "ts", "billboard_id"))
    r = spark.read.parquet(out).where(F.col("billboard_id") != MARKER)
    windows = r.select(F.lit("window").alias("side"), "billboard_id", US("w.start").alias("window_start_us"), "frames",
                       "people", "peak_crowd", "last_crowd")
    late = ST.late_rows(fr, "30 seconds")
    return windows.unionByName(late.select(
        F.lit("late").alias("side"), "billboard_id", US("ts").alias("window_start_us"), F.lit(1).cast("long").alias("frames"),
        F.col("total_people").alias("people"), F.col("cluster_count").alias("peak_crowd"), F.col("cluster_count").alias("last_crowd")))


# ------------------------------------------------------------------ T3
def _register_sliding(kind: str) -> None:
    sql = duck_sql(["fx_base", "fx_frame"], f"""on_time as (select * from fx_frame where frame_id % 10 <> 0),
{duck_history(kind, "ts_us").replace("from fx_frame", "from on_time")}""", _HIST_SELECT.format(p=f"h_{kind}"))

    @register(f"stream_sliding_{kind}", sql)
    def q(spark, sf_dir):
        fr = frames_on(spark, sf_dir, "ts_us").select("billboard_id", "frame_id", "ts", "cluster_count", "avg_density",
                                                      "flow_direction", "dwell_avg", "engagement", "attention")
        fr = received(fr, "frame_id", 300, 60)
        out = run_incremental(spark, f"stream-sliding-{kind}", fr, lambda s: ST.stream_sliding(ST.on_time(s, "2 minutes"), kind),
                              ts="ingest_ts", marker=_marker_like(fr, "ts", "billboard_id"))
        return _hist_out(spark.read.parquet(out).where(F.col("billboard_id") != MARKER))


for _kind in ("immediate", "short", "medium", "long"):
    _register_sliding(_kind)


# ------------------------------------------------------------------ T4
@register("stream_sessions", duck_sql(["fx_envelope"], """
l as (select *, lag(ts_us) over (partition by uuid order by ts_us, event_id) as pts from fx_envelope
  where ingest_us - ts_us <= 3600000000),
f as (select *, case when pts is null or ts_us - pts >= 1800000000 then 1 else 0 end as st from l),
g as (select *, sum(st) over (partition by uuid order by ts_us, event_id rows between unbounded preceding and current row)
  as sn from f)""", """
select 'session' as side, uuid, min(ts_us) as session_start_us, max(ts_us) + 1800000000 as session_end_us, count(*) as events
from g group by uuid, sn
union all select 'late', uuid, min(ts_us), max(ts_us), count(*) from fx_envelope where ingest_us - ts_us > 3600000000
group by uuid"""))
def q_stream_sessions(spark, sf_dir):
    """Sessions of the events received within an hour, and per user what came later: all events are on one side."""
    env = I.envelopes(spark, sf_dir).select("event_id", "uuid", "ts", "ingest_ts")
    out = run_incremental(spark, "stream-sessions", env, lambda s: ST.stream_sessions(ST.on_time(s, "1 hour"), "30 minutes"),
                          ts="ingest_ts", marker=_marker_like(env, "ts", "uuid", hours=48))
    r = spark.read.parquet(out).where(F.col("uuid") != MARKER)
    sessions = r.select(F.lit("session").alias("side"), "uuid", US("s.start").alias("session_start_us"),
                        US("s.end").alias("session_end_us"), "events")
    late = ST.late_rows(env, "1 hour").groupBy("uuid").agg(
        F.min(US("ts")).alias("session_start_us"), F.max(US("ts")).alias("session_end_us"), F.count(F.lit(1)).alias("events"))
    return sessions.unionByName(late.withColumn("side", F.lit("late")))


# ------------------------------------------------------------------ T5
_CONSENT_AT = ("coalesce((select arg_max(c.change, c.ts_us) from fx_consent c "
               "where c.uuid = e.uuid and c.ts_us <= e.ts_us), 'opt_in')")


@register("stream_consent", duck_sql(["fx_envelope", "fx_consent"], "", f"""
select e.event_id, e.uuid, e.event_type, e.ts_us from fx_envelope e where {_CONSENT_AT} <> 'opt_out'"""))
def q_stream_consent(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).select("event_id", "uuid", "event_type", "ts")
    log = fx.fx_consent(spark, sf_dir).select("uuid", I.ts_of("ts_us").alias("ts"), "change")
    out = run_incremental(spark, "stream-consent", env, lambda s: ST.stream_consent(s, log))
    return spark.read.parquet(out).select("event_id", "uuid", "event_type", US("ts").alias("ts_us"))


@register("stream_consent_both", duck_sql(["fx_envelope", "fx_consent"], "", f"""
select e.event_id, e.uuid, e.event_type, e.ts_us from fx_envelope e where {_CONSENT_AT} <> 'opt_out'"""))
def q_stream_consent_both(spark, sf_dir):
    """Both feeds stream: events up to 2 h late, every consent change 45 min late."""
    env = I.envelopes(spark, sf_dir).select("event_id", "uuid", "event_type", "ts", "ingest_ts")
    log = fx.fx_consent(spark, sf_dir).select("uuid", I.ts_of("ts_us").alias("ts"), "change")
    log = log.withColumn("ingest_ts", F.timestamp_add("MINUTE", F.lit(45), F.col("ts")))
    events = env.select("event_id", "uuid", "event_type", "ts")
    out = run_slices(spark, "stream-consent-both", {"events": (env, "ingest_ts"), "changes": (log, "ingest_ts")},
                     lambda s: ST.stream_consent_both(s["events"].drop("ingest_ts"), s["changes"], "3 hours")[0],
                     markers={"events": _marker_like(env, "ts", "uuid")})
    kept = ST.consented(spark.read.parquet(out), events.schema.simpleString()).where(F.col("uuid") != MARKER)
    return kept.select("event_id", "uuid", "event_type", US("ts").alias("ts_us"))


# ------------------------------------------------------------------ T6
@register("stream_current_content", duck_sql(["fx_base", "fx_play"], """
m as (select *, case event_type when 'content_start' then content_id when 'content_end' then '' end as mk from fx_play),
f as (select *, last_value(mk ignore nulls) over (partition by device_id order by ts_us, event_id
  rows between unbounded preceding and current row) as cur from m)""", """
select cast(event_id as varchar) as event_id, device_id, nullif(cur, '') as current_content from f
where event_type = 'interaction'"""))
def q_stream_current_content(spark, sf_dir):
    """Every tenth event of the devices is 2 h late, marks and interactions alike."""
    play = fx.fx_play(spark, sf_dir).select("device_id", "event_id", I.ts_of("ts_us").alias("ts"), "event_type",
                                           "content_id")
    play = received(play, "event_id", 7200, 600)
    end = _marker_like(play, "ts", "device_id").withColumn("event_type", F.lit("content_end"))
    out = run_incremental(spark, "stream-content", play, lambda s: ST.stream_current_content(s.drop("ingest_ts")), ts="ingest_ts", marker=end)
    return spark.read.parquet(out).where(~F.col("late")).select("event_id", "device_id", "current_content")


# ------------------------------------------------------------------ T7
@register("stream_ttl", duck_sql(["fx_envelope"], f"ev as (select *, {I.DUCK_TTL} as ttl from fx_envelope)", f"""
select event_id, event_type, platform, ttl from ev where ts_us + cast(ttl as bigint) * 1000000 > {I.AS_OF_US}"""))
def q_stream_ttl(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).select("event_id", "event_type", "platform", "ts", "ttl")
    out = run_incremental(spark, "stream-ttl", env, lambda s: ST.stream_ttl(s, I.as_of()))
    return spark.read.parquet(out).select("event_id", "event_type", "platform", "ttl")


_MODE_AT = ("coalesce((select arg_max(m.mode, m.ts_us) from modes m where m.billboard_id = f.billboard_id "
            "and m.ts_us <= f.ts_us), 'strict')")


@register("stream_retention", duck_sql(["fx_base", "fx_frame"], f"""{I.DUCK_MODES},
fm as (select f.*, {_MODE_AT} as mode from fx_frame f),
clr as (select billboard_id, max(ts_us) as clear_ts from modes where mode = 'strict' and ts_us <= {I.FRAME_AS_OF_US}
  group by billboard_id)""", f"""
select fm.frame_id, fm.billboard_id, fm.mode, fm.ts_us from fm left join clr on clr.billboard_id = fm.billboard_id
where fm.ts_us <= {I.FRAME_AS_OF_US}
  and fm.ts_us + cast(case fm.mode when 'strict' then 300 when 'balanced' then 1800 else 3600 end as bigint) * 1000000
      > {I.FRAME_AS_OF_US}
  and (clr.clear_ts is null or fm.ts_us >= clr.clear_ts)"""))
def q_stream_retention(spark, sf_dir):
    """What the log of held frames says is held at the as-of time: put in by then and neither expired nor cleared."""
    fr = frames_on(spark, sf_dir, "ts_us").select("billboard_id", "frame_id", "ts")
    modes = I.mode_log(spark, sf_dir)
    fr, modes = received(fr, "frame_id", 25, 10), received(modes, "frame_id", 25, 10)
    out = run_slices(spark, "stream-retention", {"frames": (fr, "ingest_ts"), "modes": (modes, "ingest_ts")},
                     lambda s: ST.stream_retention(s["frames"], s["modes"], "30 seconds"),
                     markers={"frames": _marker_like(fr, "ts", "billboard_id")})
    log = spark.read.parquet(out).where((F.col("billboard_id") != MARKER) & ~F.col("late") & (F.col("at_us") <= I.FRAME_AS_OF_US))
    state = log.groupBy("billboard_id", "frame_id").agg(
        F.count_if(F.col("action") == "hold").alias("held"), F.count_if(F.col("action") != "hold").alias("gone"),
        F.max("mode").alias("mode"), F.max(F.when(F.col("action") == "hold", F.col("at_us"))).alias("ts_us"))
    return state.where((F.col("held") == 1) & (F.col("gone") == 0)).select("frame_id", "billboard_id", "mode", "ts_us")


# ------------------------------------------------------------------ T8
@register("stream_recent_context", duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us"), """
select frame_id, n_recent, ctx_cluster_count, round(ctx_avg_density, 6) as ctx_avg_density,
  round(ctx_dwell_avg, 6) as ctx_dwell_avg, round(ctx_engagement, 6) as ctx_engagement,
  round(ctx_attention, 6) as ctx_attention, ctx_flow_direction from rc"""))
def q_stream_recent_context(spark, sf_dir):
    fr = frames_on(spark, sf_dir, "ts_us").select("billboard_id", "frame_id", "ts", "cluster_count", "avg_density",
                                                  "flow_direction", "dwell_avg", "engagement", "attention")
    fr = received(fr, "frame_id", 50, 5)
    out = run_incremental(spark, "stream-context", fr, lambda s: ST.stream_recent_context(s.drop("ingest_ts"), "1 minute"),
                          ts="ingest_ts", marker=_marker_like(fr, "ts", "billboard_id"))
    r = spark.read.parquet(out).where((F.col("billboard_id") != MARKER) & ~F.col("late"))
    return r.select("frame_id", F.col("n_recent").cast("bigint").alias("n_recent"), "ctx_cluster_count",
                    *[round6(c).alias(c) for c in ("ctx_avg_density", "ctx_dwell_avg", "ctx_engagement",
                                                   "ctx_attention")], "ctx_flow_direction")


@register("stream_context_snapshot", duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us") + ",\n" + DUCK_TICKS, """
select f.billboard_id, f.tick as tick_us, f.repeated, f.frame_id, rc.ctx_cluster_count as cluster_count,
  rc.ctx_flow_direction as flow_direction, round(rc.ctx_engagement, 6) as engagement_score
from filled f join rc on rc.frame_id = f.frame_id"""))
def q_stream_context_snapshot(spark, sf_dir):
    """Ticks up to each billboard's last frame; the repeats after it are the stream's own."""
    fr = frames_on(spark, sf_dir, "ts_us").select("billboard_id", "frame_id", "ts", "cluster_count", "avg_density",
                                                  "flow_direction", "dwell_avg", "engagement", "attention")
    fr = received(fr, "frame_id", 50, 5)
    out = run_incremental(spark, "stream-snapshot", fr, lambda s: ST.stream_context_snapshot(s.drop("ingest_ts"), 5, "1 minute"),
                          ts="ingest_ts", marker=_marker_like(fr, "ts", "billboard_id"))
    r = spark.read.parquet(out).where((F.col("billboard_id") != MARKER) & ~F.col("late"))
    last = r.where(~F.col("repeated")).groupBy("billboard_id").agg(F.max("tick_us").alias("_last"))
    return r.join(last, "billboard_id").where(F.col("tick_us") <= F.col("_last")).select(
        "billboard_id", "tick_us", "repeated", "frame_id", F.col("ctx_cluster_count").alias("cluster_count"),
        F.col("ctx_flow_direction").alias("flow_direction"), round6("ctx_engagement").alias("engagement_score"))


@register("stream_intent_trigger", duck_sql(["fx_envelope"], """
e as (select event_id, uuid, ts_us, case event_type when 'add_to_cart' then 1e0 when 'checkout_started' then 2e0
  else 3e0 end as w from fx_envelope where event_type in ('add_to_cart', 'checkout_started', 'purchase')),
t as (select *, sum(w) over (partition by uuid order by ts_us range between 604799999999 preceding and current row)
  as tw from e),
l as (select *, lag(tw) over (partition by uuid order by ts_us, event_id) as ptw from t)""", """
select event_id, uuid, round(tw, 6) as trailing_weight, 'high_purchase_intent' as rule from l
where tw >= 3 and (ptw is null or ptw < 3)"""))
def q_stream_intent_trigger(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).select("event_id", "uuid", "event_type", "ts", "ingest_ts")
    end = _marker_like(env, "ts", "uuid").withColumn("event_type", F.lit("add_to_cart"))
    out = run_incremental(spark, "stream-trigger", env, lambda s: ST.stream_intent_trigger(s.drop("ingest_ts"), 3.0, 7, "3 hours"),
                          ts="ingest_ts", marker=end)
    r = spark.read.parquet(out).where((F.col("uuid") != MARKER) & ~F.col("late"))
    return r.select("event_id", "uuid", round6("trailing_weight").alias("trailing_weight"), "rule")


# ------------------------------------------------------------------ T9
@register("stream_late_policy", duck_sql(["fx_envelope"], "", """
select case when ingest_us - ts_us > 3600000000 then 'late' else 'main' end as side, event_id, uuid, ts_us, ingest_us from fx_envelope"""))
def q_stream_late_policy(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).select("event_id", "uuid", "ts", "ingest_ts")
    base = run_incremental(spark, "stream-late", env, lambda s: s, ts="ingest_ts",
                           foreach=lambda b: ST.late_split(f"{b}/main", f"{b}/late", 3600))
    both = [spark.read.parquet(f"{base}/{side}").withColumn("side", F.lit(side)) for side in ("main", "late")]
    return both[0].unionByName(both[1]).select("side", "event_id", "uuid", US("ts").alias("ts_us"), US("ingest_ts").alias("ingest_us"))


# ------------------------------------------------------------------ T10
@register("stream_sink", duck_sql(["fx_envelope"], "", "select event_id, event_type, ts_us from fx_envelope"))
def q_stream_sink(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).select("event_id", "event_type", "uuid", "ts")
    base = run_incremental(spark, "stream-sink", env, lambda s: s,
                           foreach=lambda b: UP.write_events_batch(f"{b}/store"))
    store = spark.read.parquet(f"{base}/store")
    return store.select("event_id", "event_type", US("ts").alias("ts_us"))
