"""Event and device reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.operators import reports as RP
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.sources.fixtures import duck_sql

US = F.unix_micros
_ENV = f"env as (select *, {I.DUCK_SESSION} as session_id, cast(to_timestamp(ts_us / 1e6) as date) as event_date " \
       "from fx_envelope)"


@register("event_counts", duck_sql(["fx_envelope"], _ENV, """
select event_type, platform, event_date, count(*) as events, count(distinct uuid) as users,
  count(distinct session_id) as sessions from env group by event_type, platform, event_date"""))
def q_event_counts(spark, sf_dir):
    return RP.event_counts(I.envelopes(spark, sf_dir))


@register("event_cube", duck_sql(["fx_envelope"], "", """
select event_type, platform, cast(grouping(event_type, platform) as integer) as level, count(*) as events,
  count(distinct uuid) as users from fx_envelope group by cube (event_type, platform)"""))
def q_event_cube(spark, sf_dir):
    c = RP.event_cube(I.envelopes(spark, sf_dir))
    return c.select("event_type", "platform", F.col("level").cast("int").alias("level"), "events", "users")


@register("dwell_report", duck_sql(["fx_base", "fx_frame"], "", """
select billboard_id as location_id,
  case when (ts_us_raw // 3600000000) % 24 between 6 and 11 then 'morning'
    when (ts_us_raw // 3600000000) % 24 between 12 and 16 then 'afternoon'
    when (ts_us_raw // 3600000000) % 24 between 17 and 20 then 'evening' else 'night' end as time_of_day,
  count(*) as observations,
  round(cast(sum(cast(floor(dwell_avg * 1000 / 1000 + 0.5) as decimal(38,12))) as double) / count(*), 6)
    as avg_dwell_seconds,
  max(cast(floor(dwell_avg * 1000 / 1000 + 0.5) as bigint)) as max_dwell_seconds, max(total_people) as peak_viewers
from fx_frame group by 1, 2"""))
def q_dwell_report(spark, sf_dir):
    f = I.frames(spark, sf_dir).select(
        F.col("billboard_id").alias("location_id"), F.timestamp_micros("ts_us_raw").alias("ts"),
        (F.col("dwell_avg") * 1000).alias("dwell_time_ms"), F.col("total_people").alias("estimated_viewers"))
    d = RP.dwell_report(f)
    return d.select("location_id", "time_of_day", "observations", round6("avg_dwell_seconds").alias("avg_dwell_seconds"),
                    "max_dwell_seconds", "peak_viewers")


def diagnostics(spark, sf_dir):
    f = I.frames(spark, sf_dir)
    return f.select("billboard_id", "ts", (F.col("total_people") == 0).alias("dropped"),
                    (F.col("processing_ms") * F.lit(8.0)).alias("memory_used_mb"), F.lit(512.0).alias("memory_limit_mb"),
                    F.when(F.col("cluster_count") == 19, F.concat(F.lit("E"), F.col("frame_id").cast("string")))
                    .alias("error"))


@register("device_health", duck_sql(["fx_base", "fx_frame"], """
dg as (select billboard_id, ts_us, total_people = 0 as dropped, processing_ms * 8e0 / 512e0 * 100 as util,
  case when cluster_count = 19 then concat('E', cast(frame_id as varchar)) end as error from fx_frame)""", """
select billboard_id, count(*) as samples, round(count(*) filter (where dropped) / count(*), 6) as dropped_ratio,
  round(cast(sum(cast(util as decimal(38,12))) as double) / count(*), 6) as avg_memory_pct,
  round(max(util), 6) as peak_memory_pct, round((max(ts_us) - min(ts_us)) / 1e6, 6) as uptime_s,
  arg_max(error, {'t': ts_us, 'e': error}) filter (where error is not null) as last_error, max(ts_us) as last_seen_us
from dg group by billboard_id"""))
def q_device_health(spark, sf_dir):
    h = RP.device_health(diagnostics(spark, sf_dir))
    return h.select("billboard_id", "samples", round6("dropped_ratio").alias("dropped_ratio"),
                    round6("avg_memory_pct").alias("avg_memory_pct"), round6("peak_memory_pct").alias("peak_memory_pct"),
                    round6("uptime_s").alias("uptime_s"), "last_error", US("last_seen").alias("last_seen_us"))


@register("frame_counters", duck_sql(["fx_base", "fx_frame"], "", """
select billboard_id, count(*) as frames_analyzed, cast(sum(total_people) as bigint) as total_people, max(cluster_count) as peak_crowd,
  max(ts_us) as last_update_us,
  round(list_reduce(list_prepend(0e0, list_reverse(list_slice(list(cast(processing_ms as double)
    order by ts_us desc, frame_id desc), 1, 64))), lambda a, x: (a + x) / 2), 6) as avg_processing_ms
from fx_frame group by billboard_id"""))
def q_frame_counters(spark, sf_dir):
    c = RP.frame_counters(I.frames(spark, sf_dir))
    return c.select("billboard_id", "frames_analyzed", "total_people", "peak_crowd", US("last_update")
                    .alias("last_update_us"), round6("avg_processing_ms").alias("avg_processing_ms"))


@register("delivery_lag", duck_sql(["fx_envelope"], "", """
select platform, count(*) as events, quantile_disc(ingest_us - ts_us, 0.5) as p50_us,
  quantile_disc(ingest_us - ts_us, 0.95) as p95_us, quantile_disc(ingest_us - ts_us, 0.99) as p99_us,
  round(count(*) filter (where ingest_us - ts_us > 60000000) / count(*), 6) as late_share
from fx_envelope group by platform"""))
def q_delivery_lag(spark, sf_dir):
    d = RP.delivery_lag(I.envelopes(spark, sf_dir))
    return d.select("platform", "events", "p50_us", "p95_us", "p99_us", round6("late_share").alias("late_share"))


@register("search_topk", duck_sql(["fx_envelope"], "", """
select query, searches, round(zero_result_rate, 6) as zero_result_rate from (
  select lower(trim(concat('Query ', cast(k % 13 as varchar)))) as query, count(*) as searches,
    count(*) filter (where k % 7 = 0) / count(*) as zero_result_rate
  from fx_envelope where event_type = 'search' group by 1) t order by searches desc, query limit 10"""))
def q_search_topk(spark, sf_dir):
    t = RP.search_terms(I.envelopes(spark, sf_dir), 10)
    return t.select("query", "searches", round6("zero_result_rate").alias("zero_result_rate"))


@register("search_ctr", duck_sql(["fx_envelope"], f"""
env as (select *, {I.DUCK_SESSION} as session_id, case when event_type = 'view_venue' then 'search_result_click'
  else event_type end as et from fx_envelope),
rel as (select *, case when et = 'search' then event_id end as sid from env where et in ('search', 'search_result_click')),
a as (select *, last_value(sid ignore nulls) over (partition by session_id order by ts_us, event_id
  rows between unbounded preceding and current row) as last_search from rel),
clicked as (select distinct last_search as event_id from a where et = 'search_result_click' and last_search is not null)""",
          """
select lower(trim(concat('Query ', cast(k % 13 as varchar)))) as query, count(*) as searches,
  count(c.event_id) as clicked_searches, round(count(c.event_id) / count(*), 6) as ctr
from rel s left join clicked c on c.event_id = s.event_id where s.et = 'search' group by 1"""))
def q_search_ctr(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("event_type") == "view_venue", "search_result_click").otherwise(F.col("event_type")))
    c = RP.search_ctr(env)
    return c.select("query", "searches", "clicked_searches", round6("ctr").alias("ctr"))


@register("booking_conversion", duck_sql(["fx_envelope"], """
env as (select *, case when event_type = 'purchase' then 'booking' else event_type end as et from fx_envelope)""", """
select entity_id, count(distinct case when et in ('view_venue', 'view_event', 'view_content') then uuid end) as viewers,
  count(distinct case when et in ('favorite', 'share') then uuid end) as engaged,
  count(distinct case when et = 'booking' then uuid end) as bookers,
  round(count(distinct case when et in ('favorite', 'share') then uuid end)
    / nullif(count(distinct case when et in ('view_venue', 'view_event', 'view_content') then uuid end), 0), 6)
    as view_to_engage,
  round(count(distinct case when et = 'booking' then uuid end)
    / nullif(count(distinct case when et in ('view_venue', 'view_event', 'view_content') then uuid end), 0), 6)
    as view_to_book
from env group by entity_id"""))
def q_booking_conversion(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("event_type") == "purchase", "booking").otherwise(F.col("event_type")))
    b = RP.booking_conversion(env)
    return b.select("entity_id", "viewers", "engaged", "bookers", round6("view_to_engage").alias("view_to_engage"),
                    round6("view_to_book").alias("view_to_book"))
