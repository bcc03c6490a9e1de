"""Crowd-geometry queries (L1–L12, W8) over the frame fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.operators import geometry as GM
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.sources import fixtures as fx
from footfall.sources import lookups as L
from footfall.sources.fixtures import duck_sql

DUCK_VALID = """fv as (select frame_id, arg_min({'x': x, 'y': y, 'z': z}, {'a': o1, 'b': o2, 'c': o3}) as p
  from fx_point group by frame_id),
valid as (select frame_id, coalesce(p.x <> 0 and p.y <> 0 and p.z <> 0, false) as valid from fv)"""

DUCK_FILTER = """(x between -50 and 50 and y between -50 and 50 and z between -50 and 50 and x >= 0
  and sqrt(x * x + y * y + z * z) >= 0.5 and sqrt(x * x + y * y + z * z) <= 50
  and abs(degrees(atan2(y, x))) <= 20)"""

_NEAR = "list_filter(r.seeds, lambda s: sqrt((s.x - d.x) * (s.x - d.x) + (s.y - d.y) * (s.y - d.y)) < 1.5)"
DUCK_CLUSTERS = f"""d as (select frame_id, o1, o2, o3, x, y, z, confidence,
  row_number() over (partition by frame_id order by o1, o2, o3) as rn from fx_detection),
r as (
  select frame_id, rn, [{{'x': x, 'y': y, 'id': 0}}] as seeds, [0] as labels from d where rn = 1
  union all
  select d.frame_id, d.rn,
    case when len({_NEAR}) > 0 then r.seeds
      else list_append(r.seeds, {{'x': d.x, 'y': d.y, 'id': cast(len(r.seeds) as integer)}}) end,
    list_append(r.labels, case when len({_NEAR}) > 0 then {_NEAR}[1].id else cast(len(r.seeds) as integer) end)
  from r join d on d.frame_id = r.frame_id and d.rn = r.rn + 1
),
nmax as (select frame_id, max(rn) as n from d group by frame_id),
fin as (select r.frame_id, r.labels from r join nmax on r.frame_id = nmax.frame_id and r.rn = nmax.n),
cl as (select d.*, cast(fin.labels[d.rn] as integer) as cluster_id from d join fin on fin.frame_id = d.frame_id),
cs as (select frame_id, cluster_id, count(*) as size, avg(x) as cx, avg(y) as cy, avg(z) as cz,
  count(*) / (pi() * 1.5 * 1.5) as density from cl group by frame_id, cluster_id)"""

DUCK_FLOW = """fl as (select frame_id, avg(direction) as mean_deg, sum(sin(radians(direction))) as ssin,
  sum(cos(radians(direction))) as scos, avg(speed) as average_speed, count(*) / 10e0 as flow_intensity,
  count(*) filter (where trajectory = 'towards_billboard') as towards,
  count(*) filter (where trajectory = 'away_from_billboard') as away from fx_movement group by frame_id)"""

_CARD = ("(['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'])"
         "[cast(floor(fmod({d} + 22.5, 360) / 45) as integer) + 1]")


@register("validate_frames", duck_sql(["fx_point"], DUCK_VALID, "select frame_id, valid from valid"))
def q_validate_frames(spark, sf_dir):
    return GM.validate_frames(fx.fx_point(spark, sf_dir))


@register("filter_points", duck_sql(["fx_point"], DUCK_VALID, f"""
select p.frame_id, p.o1, p.o2, p.o3 from fx_point p join valid v on v.frame_id = p.frame_id and v.valid
where {DUCK_FILTER}"""))
def q_filter_points(spark, sf_dir):
    pts = GM.valid_points(fx.fx_point(spark, sf_dir))
    return GM.filter_points(pts).select("frame_id", "o1", "o2", "o3")


@register("frame_stats", duck_sql(["fx_point"], DUCK_VALID, f"""
select p.frame_id, count(*) as raw_points, any_value(v.valid) as accepted,
  case when any_value(v.valid) then count(*) filter (where {DUCK_FILTER}) else 0 end as kept_points
from fx_point p join valid v on v.frame_id = p.frame_id group by p.frame_id"""))
def q_frame_stats(spark, sf_dir):
    return GM.frame_stats(fx.fx_point(spark, sf_dir))


@register("cluster_detections", duck_sql(["fx_detection"], DUCK_CLUSTERS,
          "select frame_id, o1, o2, o3, cluster_id from cl", recursive=True))
def q_cluster_detections(spark, sf_dir):
    cl = GM.cluster_detections(fx.fx_detection(spark, sf_dir))
    return cl.select("frame_id", "o1", "o2", "o3", "cluster_id")


@register("cluster_stats", duck_sql(["fx_detection"], DUCK_CLUSTERS, """
select frame_id, cluster_id, size, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz,
  round(density, 6) as density from cs""", recursive=True))
def q_cluster_stats(spark, sf_dir):
    st = GM.cluster_stats(GM.cluster_detections(fx.fx_detection(spark, sf_dir)))
    return st.select("frame_id", "cluster_id", "size", *[round6(c).alias(c) for c in ("cx", "cy", "cz", "density")])


@register("frame_confidence", duck_sql(["fx_detection"], DUCK_CLUSTERS, """
select d.frame_id, round(0.7 * d.ac + 0.3 * least(coalesce(c.ad, 0), 1), 6) as confidence
from (select frame_id, avg(confidence) as ac from fx_detection group by frame_id) d
left join (select frame_id, avg(density) as ad from cs group by frame_id) c on c.frame_id = d.frame_id""",
          recursive=True))
def q_frame_confidence(spark, sf_dir):
    det = fx.fx_detection(spark, sf_dir)
    st = GM.cluster_stats(GM.cluster_detections(det))
    return GM.frame_confidence(det, st).select("frame_id", round6("confidence").alias("confidence"))


@register("engagement_metrics", duck_sql(["fx_pose"], "", """
select frame_id, round(count(*) filter (where estimated_attention = 'billboard') / count(*), 6) as attention_rate,
  round(avg(engagement_score), 6) as average_engagement,
  count(*) filter (where engagement_score > 0.7) as high,
  count(*) filter (where engagement_score > 0.4 and engagement_score <= 0.7) as medium,
  count(*) filter (where engagement_score <= 0.4) as low
from fx_pose group by frame_id"""))
def q_engagement_metrics(spark, sf_dir):
    e = GM.engagement_metrics(fx.fx_pose(spark, sf_dir))
    return e.select("frame_id", round6("attention_rate").alias("attention_rate"),
                    round6("average_engagement").alias("average_engagement"), "high", "medium", "low")


def _flow_q(circular: bool):
    def q(spark, sf_dir):
        f = GM.flow_analysis(fx.fx_movement(spark, sf_dir), circular=circular)
        return f.select("frame_id", round6("avg_direction").alias("avg_direction"), "dominant_direction",
                        round6("average_speed").alias("average_speed"), round6("flow_intensity").alias("flow_intensity"),
                        "towards", "away")
    return q


_CIRC = "round((degrees(atan2(ssin, scos)) + 360) % 360, 9)"
register("flow_analysis", duck_sql(["fx_movement"], DUCK_FLOW, f"""
select frame_id, round(mean_deg, 6) as avg_direction, {_CARD.format(d='mean_deg')} as dominant_direction,
  round(average_speed, 6) as average_speed, round(flow_intensity, 6) as flow_intensity, towards, away from fl"""))(
    _flow_q(False))
register("flow_analysis_circular", duck_sql(["fx_movement"], DUCK_FLOW, f"""
select frame_id, round({_CIRC}, 6) as avg_direction, {_CARD.format(d=_CIRC)} as dominant_direction,
  round(average_speed, 6) as average_speed, round(flow_intensity, 6) as flow_intensity, towards, away from fl"""))(
    _flow_q(True))


@register("filter_points_by_sensor", duck_sql(["fx_point"], """
p as (select *, case frame_id % 6 when 0 then 10e0 when 1 then 20e0 when 2 then 120e0 when 3 then 50e0 when 4 then 20e0 else 50e0 end as r,
  case frame_id % 6 when 4 then 360e0 else 40e0 end as fov from fx_point)""", """
select frame_id, o1, o2, o3 from p where sqrt(x * x + y * y + z * z) between 0.5 and r and abs(degrees(atan2(y, x))) <= fov / 2"""))
def q_filter_points_by_sensor(spark, sf_dir):
    """Points of frames of five kinds of sensors and one unknown, each with its own limits."""
    names = F.array(*[F.lit(n) for n in (*L.SENSORS, "unknown")])
    pts = fx.fx_point(spark, sf_dir).withColumn("sensor", F.element_at(names, (F.col("frame_id") % 6 + 1).cast("int")))
    return GM.filter_points(pts, *L.sensor_limits(F.col("sensor"))).select("frame_id", "o1", "o2", "o3")


@register("movements_from_tracks", duck_sql(["fx_detection"], """
t as (select frame_id as track_id, o1, o2, o3, x, y, lag(x) over w as px, lag(y) over w as py
  from fx_detection window w as (partition by frame_id order by o1, o2, o3))""", """
select track_id, o1, o2, o3,
  round((degrees(atan2(x - px, y - py)) + 360) % 360, 6) as direction,
  round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 0.1, 6) as speed,
  case when sqrt(x * x + y * y) < sqrt(px * px + py * py) then 'towards_billboard' else 'away_from_billboard' end
    as trajectory
from t where px is not null"""))
def q_movements_from_tracks(spark, sf_dir):
    tr = fx.fx_detection(spark, sf_dir).withColumnRenamed("frame_id", "track_id")
    m = GM.movements_from_tracks(tr, "track_id", ("o1", "o2", "o3"), dt_s=F.lit(0.1))
    return m.select("track_id", "o1", "o2", "o3", round6("direction").alias("direction"),
                    round6("speed").alias("speed"), "trajectory")


@register("age_distribution", duck_sql([], """
c as (select l_orderkey as frame_id, (['18-25', '26-35', '36-50', '50+'])[l_partkey % 4 + 1] as bucket,
  count(*) as share from lineitem group by 1, 2)""", """
select frame_id, bucket, cast(floor(100e0 * share / sum(share) over (partition by frame_id) + 0.5) as bigint) as pct
from c"""))
def q_age_distribution(spark, sf_dir):
    li = fx.read_table(spark, sf_dir, "lineitem")
    c = li.groupBy(F.col("l_orderkey").alias("frame_id"), F.element_at(
        F.array(*[F.lit(b) for b in ("18-25", "26-35", "36-50", "50+")]), (F.col("l_partkey") % 4 + 1).cast("int"))
        .alias("bucket")).agg(F.count(F.lit(1)).alias("share"))
    return GM.age_distribution(c).select("frame_id", "bucket", "pct")


def frame_metrics_df(spark, sf_dir):
    clustered = GM.cluster_detections(fx.fx_detection(spark, sf_dir))
    flow = GM.flow_analysis(fx.fx_movement(spark, sf_dir))
    return GM.frame_metrics(clustered, flow, GM.engagement_metrics(fx.fx_pose(spark, sf_dir)))


@register("frame_metrics", duck_sql(["fx_detection", "fx_movement", "fx_pose"], DUCK_CLUSTERS + ",\n" + DUCK_FLOW + """,
eg as (select frame_id, count(*) filter (where estimated_attention = 'billboard') / count(*) as att,
  avg(engagement_score) as eng from fx_pose group by frame_id),
pp as (select frame_id, count(*) as total_people, avg(confidence) as ac from fx_detection group by frame_id),
cm as (select frame_id, count(*) as cluster_count, avg(density) as avg_density,
  avg(least(size * density * 30, 300)) as dwell_avg, max(least(size * density * 45, 600)) as dwell_max
  from cs group by frame_id)""", f"""
select pp.frame_id, coalesce(cm.cluster_count, 0) as cluster_count, pp.total_people,
  round(coalesce(cm.avg_density, 0), 6) as avg_density,
  coalesce({_CARD.format(d='fl.mean_deg')}, 'unknown') as flow_direction,
  round(coalesce(nullif(fl.flow_intensity, 0), 0), 6) as flow_intensity,
  round(coalesce(nullif(fl.average_speed, 0), 0), 6) as average_speed,
  round(coalesce(cm.dwell_avg, 0), 6) as dwell_avg, round(coalesce(cm.dwell_max, 0), 6) as dwell_max,
  round(coalesce(nullif(eg.eng, 0), 0), 6) as engagement, round(coalesce(nullif(eg.att, 0), 0), 6) as attention,
  round(coalesce(nullif(0.7 * pp.ac + 0.3 * least(coalesce(cm.avg_density, 0), 1), 0), 0), 6) as confidence
from pp left join cm on cm.frame_id = pp.frame_id left join fl on fl.frame_id = pp.frame_id
left join eg on eg.frame_id = pp.frame_id""", recursive=True))
def q_frame_metrics(spark, sf_dir):
    m = frame_metrics_df(spark, sf_dir)
    dbl = ("avg_density", "flow_intensity", "average_speed", "dwell_avg", "dwell_max", "engagement", "attention",
           "confidence")
    return m.select("frame_id", "cluster_count", "total_people", "flow_direction",
                    *[round6(c).alias(c) for c in dbl])


@register("time_of_day", duck_sql(["fx_base", "fx_frame"], "", """
select frame_id, cast((ts_us_raw // 3600000000) % 24 as bigint) as hour,
  cast((ts_us_raw // 86400000000 + 4) % 7 as bigint) as day_of_week,
  case when (ts_us_raw // 3600000000) % 24 between 6 and 11 then 'morning'
    when (ts_us_raw // 3600000000) % 24 between 12 and 16 then 'afternoon'
    when (ts_us_raw // 3600000000) % 24 between 17 and 20 then 'evening' else 'night' end as time_of_day,
  case when (ts_us_raw // 3600000000) % 24 between 6 and 19 then 'daylight' else 'artificial' end as lighting
from fx_frame"""))
def q_time_of_day(spark, sf_dir):
    f = GM.frame_time_context(fx.fx_frame(spark, sf_dir), "ts_us_raw")
    return f.select("frame_id", "hour", "day_of_week", "time_of_day", "lighting")


@register("frame_rate", duck_sql(["fx_base", "fx_frame"], "", """
select frame_id, billboard_id, round(1000e0 / nullif((ts_us - lag(ts_us) over (partition by billboard_id
  order by ts_us, frame_id)) / 1000e0, 0), 6) as frame_rate from fx_frame"""))
def q_frame_rate(spark, sf_dir):
    fr = GM.frame_rate(I.frames(spark, sf_dir))
    return fr.select("frame_id", "billboard_id", round6("frame_rate").alias("frame_rate"))
