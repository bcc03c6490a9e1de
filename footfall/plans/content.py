"""Content-choice queries (O1–O5, W7, A3, A5, A6) on the per-frame context
of ``fx_frame`` (compressed clock; time of day from the raw clock)."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.functions.timeparts import hour_of_us, time_of_day
from footfall.operators import content as CT
from footfall.operators import context as CX
from footfall.plans.context import duck_recent, frames_on
from footfall.plans.registry import register
from footfall.sources import lookups as L
from footfall.sources.fixtures import duck_sql

ANALYTICS_AS_OF_US = 1706659200000000  # 2024-01-31T00:00:00Z (raw clock)


def chain(spark, sf_dir):
    ctx = CX.recent_context(frames_on(spark, sf_dir, "ts_us"))
    ctx = ctx.withColumn("time_of_day", time_of_day(hour_of_us(F.col("ts_us_raw"))))
    return CT.select_content(CT.score_content(ctx))


def rotations(spark, sf_dir):
    return CT.content_rotation(chain(spark, sf_dir))


def imps(spark, sf_dir):
    return CT.impressions(rotations(spark, sf_dir))


_TOD = """case when (ts_us_raw // 3600000000) % 24 between 6 and 11 then 'morning'
  when (ts_us_raw // 3600000000) % 24 between 12 and 16 then 'afternoon'
  when (ts_us_raw // 3600000000) % 24 between 17 and 20 then 'evening' else 'night' end"""

DUCK_CHAIN = duck_recent("ts_us") + f""",
sc as (select *, {_TOD} as tod, ctx_cluster_count as cc, ctx_engagement as eng from rc),
s0 as (select *, [
  {{'pos': 0, 'id': 'premium_fashion', 's': 100e0 + (case when cc >= 8 then 30e0 else 0e0 end)
     + (case when eng >= 0.6 then 25e0 else 0e0 end) + ln(501e0) * 5}},
  {{'pos': 1, 'id': 'tech_startup', 's': 50e0 + (case when cc >= 5 then 30e0 else 0e0 end) + ln(201e0) * 5}},
  {{'pos': 2, 'id': 'local_restaurant', 's': 50e0 + (case when cc >= 3 then 30e0 else 0e0 end)
     + (case when tod in ('morning', 'afternoon') then 15e0 else 0e0 end) + ln(101e0) * 5}},
  {{'pos': 3, 'id': 'public_service', 's': 25e0 + (case when cc >= 1 then 30e0 else 0e0 end) + ln(1e0) * 5}},
  {{'pos': 4, 'id': 'attention_grabber', 's': 50e0 + (case when cc <= 3 then 20e0 else 0e0 end)
     + (case when eng < 0.4 then 30e0 else 0e0 end) + ln(51e0) * 5}}] as scores from sc),
sel as (select *, list_max(list_transform(scores, lambda x: {{'s': x.s, 'np': -x.pos, 'id': x.id}})) as best from s0),
rot0 as (select *, best.id as selected, lag(best.id) over (partition by billboard_id order by t, frame_id) as prev
  from sel),
rot as (select * from rot0 where prev is null or prev <> selected),
imp as (select *, selected as content_id, greatest(1, cast(floor(cc * 1.2 + 0.5) as bigint)) as viewers,
  case selected when 'premium_fashion' then 15000 when 'tech_startup' then 12000 when 'local_restaurant' then 10000
    when 'public_service' then 8000 else 20000 end as duration_ms,
  case selected when 'premium_fashion' then 500e0 when 'tech_startup' then 200e0 when 'local_restaurant' then 100e0
    when 'public_service' then 0e0 else 50e0 end as revenue from rot)"""


@register("score_content", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, """
select frame_id, x.pos as pos, x.id as content_id, round(x.s, 6) as score from (select frame_id, unnest(scores) as x
  from s0) t"""))
def q_score_content(spark, sf_dir):
    c = chain(spark, sf_dir)
    return c.select("frame_id", F.explode("scores").alias("x")).select(
        "frame_id", F.col("x.pos").alias("pos"), F.col("x.content_id").alias("content_id"),
        round6("x.score").alias("score"))


@register("select_content", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, """
select frame_id, best.id as selected_content, round(best.s, 6) as selected_score from sel"""))
def q_select_content(spark, sf_dir):
    c = chain(spark, sf_dir)
    return c.select("frame_id", "selected_content", round6("selected_score").alias("selected_score"))


@register("content_rotation", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, """
select billboard_id, frame_id, prev as previous_content, selected as new_content, 'context_driven' as reason
from rot"""))
def q_content_rotation(spark, sf_dir):
    r = rotations(spark, sf_dir)
    return r.select("billboard_id", "frame_id", "previous_content", "new_content", "reason")


@register("estimated_viewers", duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us"), """
select frame_id, greatest(1, cast(floor(ctx_cluster_count * 1.2 + 0.5) as bigint)) as estimated_viewers from rc"""))
def q_estimated_viewers(spark, sf_dir):
    c = CX.recent_context(frames_on(spark, sf_dir, "ts_us"))
    return c.select("frame_id", CT.estimated_viewers(F.col("ctx_cluster_count")).alias("estimated_viewers"))


@register("content_rule", duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us"), """
select frame_id, case when ctx_cluster_count > 10 and ctx_engagement > 0.7 then 'premium'
  when ctx_cluster_count < 3 then 'interactive' else 'keep' end as content_rule from rc"""))
def q_content_rule(spark, sf_dir):
    c = CT.content_rule(CX.recent_context(frames_on(spark, sf_dir, "ts_us")))
    return c.select("frame_id", "content_rule")


@register("impression_report", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, """
select billboard_id, content_id, count(*) as impressions, cast(sum(viewers) as bigint) as total_viewers,
  cast(sum(duration_ms) as bigint) as total_display_ms from imp group by billboard_id, content_id"""))
def q_impression_report(spark, sf_dir):
    from footfall.operators.reports import impression_report
    return impression_report(imps(spark, sf_dir), "billboard_id")


@register("content_lift", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, """
select content_id, count(*) as impressions, round(avg(viewers), 6) as avg_viewers,
  round(cast(sum(cast(eng as decimal(38,12))) as double) / count(*), 6) as engagement_rate,
  round(sum(revenue) / count(*), 6) as revenue_per_impression from imp group by content_id"""))
def q_content_lift(spark, sf_dir):
    g = CT.content_lift(imps(spark, sf_dir))
    return g.select("content_id", "impressions", *[round6(c).alias(c) for c in ("avg_viewers", "engagement_rate",
                                                                                 "revenue_per_impression")])


@register("performance_summary", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, f"""
select billboard_id, count(*) as impressions, max(cc) as peak_crowd, count(*) as rotations,
  round(list_reduce(list_prepend(0e0, list_reverse(list_slice(list(eng order by t desc, frame_id desc), 1, 64))),
    lambda a, x: (a + x) / 2), 6) as avg_engagement,
  count(*) * {L.REVENUE_PER_IMPRESSION} as revenue from imp group by billboard_id"""))
def q_performance_summary(spark, sf_dir):
    from footfall.operators.reports import performance_summary
    p = performance_summary(imps(spark, sf_dir), "billboard_id")
    return p.select("billboard_id", "impressions", "peak_crowd", "rotations",
                    round6("avg_engagement").alias("avg_engagement"), "revenue")


@register("billboard_analytics", duck_sql(["fx_base", "fx_frame"], DUCK_CHAIN, f"""
select billboard_id, count(*) as total_impressions,
  round(cast(sum(cast(eng as decimal(38,12))) as double) / count(*), 6) as avg_engagement, max(cc) as peak_crowd,
  round(sum(revenue), 6) as total_revenue, arg_max(content_id, {{'r': rv, 'c': content_id}}) as top_content
from (select *, sum(revenue) over (partition by billboard_id, content_id) as rv from imp
  where ts_us_raw > {ANALYTICS_AS_OF_US} - 30 * 86400000000 and ts_us_raw <= {ANALYTICS_AS_OF_US}) x
group by billboard_id"""))
def q_billboard_analytics(spark, sf_dir):
    from footfall.operators.reports import billboard_analytics
    i = imps(spark, sf_dir).withColumn("ts_raw", F.timestamp_micros("ts_us_raw"))
    a = billboard_analytics(i, F.timestamp_micros(F.lit(ANALYTICS_AS_OF_US)), 30, key="billboard_id", ts="ts_raw")
    return a.select("billboard_id", "total_impressions", round6("avg_engagement").alias("avg_engagement"),
                    "peak_crowd", round6("total_revenue").alias("total_revenue"), "top_content")
