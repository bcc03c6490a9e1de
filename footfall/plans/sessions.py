"""Session, lifecycle and playback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.operators import sessions as SS
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.sources import fixtures as fx
from footfall.sources.fixtures import duck_sql

US = F.unix_micros


@register("session_summary", duck_sql(["fx_envelope"], f"env as (select *, {I.DUCK_SESSION} as session_id "
                                                       "from fx_envelope)", """
select session_id, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as depth,
  arg_min(entity_id, {'t': ts_us, 'e': event_id}) as entry_page, arg_max(entity_id, {'t': ts_us, 'e': event_id})
  as exit_page, arg_min(platform, {'t': ts_us, 'e': event_id}) as platform,
  round((max(ts_us) - min(ts_us)) / 1000e0, 6) as duration_ms from env group by session_id"""))
def q_session_summary(spark, sf_dir):
    s = SS.session_summary(I.envelopes(spark, sf_dir))
    return s.select("session_id", US("start_ts").alias("start_us"), US("end_ts").alias("end_us"), "depth",
                    "entry_page", "exit_page", "platform", round6("duration_ms").alias("duration_ms"))


@register("sessionize_gap", duck_sql(["fx_envelope"], """
l as (select *, lag(ts_us) over (partition by uuid order by ts_us, event_id) as pts from fx_envelope),
f as (select *, pts is null or ts_us - pts >= 1800000000 as st from l),
g as (select *, max(case when st then ts_us end) over (partition by uuid order by ts_us, event_id
  rows between unbounded preceding and current row) as s0 from f)""", """
select event_id, concat(uuid, '#', cast(s0 as varchar)) as gap_session_id, st as is_session_start from g"""))
def q_sessionize_gap(spark, sf_dir):
    s = SS.sessionize(I.envelopes(spark, sf_dir), 1800)
    return s.select("event_id", "gap_session_id", "is_session_start")


_LIFE = ["app_open", "app_foreground", "app_background", "app_terminate"]


def _lifecycle(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    return env.withColumn("event_type", F.element_at(F.array(*[F.lit(x) for x in _LIFE]),
                                                     (F.col("k") % 4 + 1).cast("int")))


@register("foreground_spans", duck_sql(["fx_envelope"], """
lc as (select uuid, event_id, ts_us, case when k % 4 < 2 then 'fg' else 'bg' end as st from fx_envelope),
ch as (select * from (select *, lag(st) over (partition by uuid order by ts_us, event_id) as pst from lc) x
  where pst is null or pst <> st),
pr as (select *, lag(st) over w as p_st, lag(ts_us) over w as p_ts, lag(event_id) over w as p_id from ch
  window w as (partition by uuid order by ts_us, event_id))""", """
select uuid, p_id as start_event_id, p_ts as start_us, ts_us as end_us, round((ts_us - p_ts) / 1000e0, 6)
  as foreground_ms from pr where st = 'bg' and p_st = 'fg'"""))
def q_foreground_spans(spark, sf_dir):
    s = SS.foreground_spans(_lifecycle(spark, sf_dir))
    return s.select("uuid", "start_event_id", US("start_ts").alias("start_us"), US("end_ts").alias("end_us"),
                    round6("foreground_ms").alias("foreground_ms"))


@register("page_flow", duck_sql(["fx_envelope"], f"""
env as (select *, {I.DUCK_SESSION} as session_id from fx_envelope),
t as (select lag(entity_id) over w as from_page, entity_id as to_page, (ts_us - lag(ts_us) over w) / 1000e0 as ms
  from env window w as (partition by session_id order by ts_us, event_id))""", """
select from_page, to_page, count(*) as transitions,
  round(cast(sum(cast(ms as decimal(38,12))) as double) / count(*), 6) as avg_time_on_page_ms
from t where from_page is not null group by from_page, to_page"""))
def q_page_flow(spark, sf_dir):
    g = SS.page_flow(I.envelopes(spark, sf_dir), F.col("entity_id"))
    return g.select("from_page", "to_page", "transitions", round6("avg_time_on_page_ms").alias("avg_time_on_page_ms"))


@register("play_intervals", duck_sql(["fx_base", "fx_play"], """
se as (select * from fx_play where event_type in ('content_start', 'content_end')),
nx as (select *, lead(event_type) over w as n_type, lead(ts_us) over w as n_ts, lead(event_id) over w as n_id
  from se window w as (partition by device_id order by ts_us, event_id))""", """
select device_id, event_id as start_event_id, content_id, ts_us as start_us,
  case when n_type = 'content_end' then n_ts end as end_us, case when n_type = 'content_end' then n_id end
  as end_event_id, case when n_type = 'content_end' then 'closed' else 'open' end as status,
  case when n_type = 'content_end' then round((n_ts - ts_us) / 1000e0, 6) end as played_ms
from nx where event_type = 'content_start'"""))
def q_play_intervals(spark, sf_dir):
    play = fx.fx_play(spark, sf_dir).withColumn("ts", I.ts_of("ts_us"))
    p = SS.play_intervals(play)
    return p.select("device_id", "start_event_id", "content_id", US("start_ts").alias("start_us"),
                    US("end_ts").alias("end_us"), "end_event_id", "status", round6("played_ms").alias("played_ms"))


@register("completion_rate", duck_sql(["fx_base", "fx_play"], "", """
select event_id, round(case when actual_ms <> 0 and planned_ms <> 0 then least(1, actual_ms / planned_ms) end, 6)
  as completion_rate from fx_play where event_type = 'content_end'"""))
def q_completion_rate(spark, sf_dir):
    play = fx.fx_play(spark, sf_dir).where(F.col("event_type") == "content_end")
    return play.select("event_id", round6(SS.completion_rate(F.col("actual_ms"), F.col("planned_ms")))
                       .alias("completion_rate"))


@register("half_ewma", duck_sql(["fx_base", "fx_frame"], "", """
select frame_id, round(list_reduce(list_prepend(0e0, list(cast(processing_ms as double)) over (partition by billboard_id
  order by ts_us, frame_id rows between 63 preceding and current row)), lambda a, x: (a + x) / 2), 6) as half_ewma
from fx_frame"""))
def q_half_ewma(spark, sf_dir):
    f = I.frames(spark, sf_dir)
    e = SS.half_ewma(f, "billboard_id", ["ts", "frame_id"], "processing_ms")
    return e.select("frame_id", round6("half_ewma").alias("half_ewma"))
