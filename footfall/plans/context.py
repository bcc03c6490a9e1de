"""Context-window queries (X1–X12) over ``fx_frame``.

X1–X7 and X11 run on the compressed frame clock (``ts_us``: 30 s windows
hold many frames, and the 100-frame cap binds at sf0.1).  The baseline
chain X8–X10, X12 runs on the raw clock (``ts_us_raw``), where weekday and
hour are meaningful."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.functions.timeparts import ts_of
from footfall.operators import context as CX
from footfall.plans.registry import register
from footfall.sources import fixtures as fx
from footfall.sources.fixtures import duck_sql

US = F.unix_micros


def frames_on(spark, sf_dir, clock: str):
    f = fx.fx_frame(spark, sf_dir)
    return f.withColumn("ts", ts_of(clock))


def ctx_on(spark, sf_dir, clock: str):
    return CX.recent_context(frames_on(spark, sf_dir, clock))


# ------------------------------------------------------------- DuckDB text
def duck_recent(clock: str, name: str = "rc") -> str:
    """CTEs ending in ``{name}``: X1–X6 per frame on the given clock."""
    return f"""{name}_w as (select billboard_id, frame_id, {clock} as t, ts_us_raw,
  list({{'t': {clock}, 'cc': cast(cluster_count as double), 'dn': avg_density, 'fl': flow_direction, 'dw': dwell_avg,
    'en': engagement, 'at': attention}}) over (partition by billboard_id order by {clock}, frame_id
    rows between 99 preceding and current row) as h from fx_frame),
{name}_0 as (select billboard_id, frame_id, t, ts_us_raw, list_filter(h, lambda x: x.t >= t - 30000000) as rec
  from {name}_w),
{name}_1 as (select *, len(rec) as n, len(rec) // 2 as half,
  list_transform(rec, lambda x: coalesce(x.cc, 0)) as ccs, list_transform(rec, lambda x: coalesce(x.dn, 0)) as dns,
  list_transform(rec, lambda x: coalesce(x.dw, 0)) as dws, list_transform(rec, lambda x: coalesce(x.en, 0)) as ens,
  list_transform(rec, lambda x: coalesce(x.at, 0)) as ats,
  list_transform(rec, lambda x: coalesce(x.fl, 'unknown')) as fls from {name}_0),
{name}_2 as (select *, list_sum(ccs) / n as acc, list_sum(dns) / n as adn, list_sum(dws) / n as adw,
  list_sum(ens) / n as aen, list_sum(ats) / n as aat,
  list_sum(list_slice(ccs, 1, half)) / half as cc1, list_sum(list_slice(ccs, half + 1, n)) / (n - half) as cc2,
  list_sum(list_slice(dns, 1, half)) / half as dn1, list_sum(list_slice(dns, half + 1, n)) / (n - half) as dn2,
  list_sum(list_slice(ens, 1, half)) / half as en1, list_sum(list_slice(ens, half + 1, n)) / (n - half) as en2,
  list_max(list_transform(list_distinct(fls), lambda v: {{'c': len(list_filter(fls, lambda y: y = v)),
    'p': list_position(fls, v), 'v': v}})).v as dom,
  len(list_distinct(list_transform(rec, lambda x: x.fl))) as ndist, list_max(ccs) as peak from {name}_1),
{name}_3 as (select *,
  list_sum(list_transform(ccs, lambda v: (v - acc) * (v - acc))) / n as vcc,
  list_sum(list_transform(dns, lambda v: (v - adn) * (v - adn))) / n as vdn from {name}_2),
{name} as (select billboard_id, frame_id, t, ts_us_raw, n as n_recent,
  cast(floor(acc + 0.5) as bigint) as ctx_cluster_count, adn as ctx_avg_density, coalesce(dom, 'unknown')
    as ctx_flow_direction, adw as ctx_dwell_avg, aen as ctx_engagement, aat as ctx_attention,
  {_trend('cc1', 'cc2')} as crowd_trend, {_trend('dn1', 'dn2')} as density_trend,
  {_trend('en1', 'en2')} as engagement_trend,
  case when n < 3 then 'unknown' else (case
    when ({_stab('acc', 'vcc')} + {_stab('adn', 'vdn')} + (1 - (ndist - 1) / greatest(n - 1, 1))) / 3 > 0.8
      then 'very_stable'
    when ({_stab('acc', 'vcc')} + {_stab('adn', 'vdn')} + (1 - (ndist - 1) / greatest(n - 1, 1))) / 3 > 0.6
      then 'stable'
    when ({_stab('acc', 'vcc')} + {_stab('adn', 'vdn')} + (1 - (ndist - 1) / greatest(n - 1, 1))) / 3 > 0.4
      then 'moderate'
    when ({_stab('acc', 'vcc')} + {_stab('adn', 'vdn')} + (1 - (ndist - 1) / greatest(n - 1, 1))) / 3 > 0.2
      then 'unstable'
    else 'very_unstable' end) end as stability,
  case when n >= 5 then peak end as peak_crowd,
  case when n >= 5 then (case when acc > 0 then peak / acc else 1 end) end as peak_ratio,
  case when n >= 5 then peak > acc * 1.5 end as is_peak,
  case when n >= 5 then rec[list_position(ccs, peak)].t end as peak_ts_us
  from {name}_3)"""


def _trend(a1: str, a2: str) -> str:
    return (f"(case when n < 2 then 'stable' when {a1} = 0 then (case when {a2} > 0 then 'increasing' "
            f"when {a2} < 0 then 'decreasing' else 'stable' end) when ({a2} - {a1}) / {a1} > 0.1 then 'increasing' "
            f"when ({a2} - {a1}) / {a1} < -0.1 then 'decreasing' else 'stable' end)")


def _stab(mean: str, var: str) -> str:
    return f"greatest(0, 1 - (case when {mean} > 0 then sqrt({var}) / {mean} else 1 end))"


def duck_history(kind: str, clock: str, compat: bool = False) -> str:
    dur, slide = CX.WINDOW_KINDS[kind]
    length = dur + slide if compat else dur
    s_us, l_us, nwin = slide * 1_000_000, length * 1_000_000, length // slide
    p = f"h_{kind}"
    return f"""{p}_w as (select billboard_id, frame_id, {clock} as t, cluster_count, avg_density, flow_direction, dwell_avg,
  engagement, {clock} - ({clock} % {s_us}) - r.j * {s_us} as ws from fx_frame cross join range(0, {nwin}) as r(j)),
{p}_d as (select billboard_id, ws, coalesce(flow_direction, 'unknown') as dir, count(*) as c,
  min({{'t': t, 'f': frame_id}}) as first, sum(cast(coalesce(cluster_count, 0) as decimal(38,12))) as s_cc,
  sum(cast(coalesce(avg_density, 0) as decimal(38,12))) as s_dn, sum(cast(coalesce(dwell_avg, 0) as decimal(38,12))) as s_dw,
  sum(cast(coalesce(engagement, 0) as decimal(38,12))) as s_en from {p}_w group by 1, 2, 3),
{p} as (select billboard_id, '{kind}' as window_type, ws + {l_us} as ts_us, {length * 1000} as duration_ms,
  cast(sum(c) as bigint) as n, cast(sum(s_cc) as double) / sum(c) as cluster_count, cast(sum(s_dn) as double) / sum(c) as avg_density,
  cast(sum(s_dw) as double) / sum(c) as dwell_avg, cast(sum(s_en) as double) / sum(c) as engagement, arg_max(dir, {{'c': c, 'f': first}}) as flow_direction
  from {p}_d group by billboard_id, ws)"""


def _hist_out(h):
    return h.select("billboard_id", "window_type", US("ts").alias("ts_us"), "duration_ms", "n",
                    *[round6(c).alias(c) for c in ("cluster_count", "avg_density", "dwell_avg", "engagement")],
                    "flow_direction")


_HIST_SELECT = """select billboard_id, window_type, ts_us, duration_ms, n, round(cluster_count, 6) as cluster_count,
  round(avg_density, 6) as avg_density, round(dwell_avg, 6) as dwell_avg, round(engagement, 6) as engagement,
  flow_direction from {p}"""

_RC_COLS = ("n_recent", "ctx_cluster_count", "ctx_avg_density", "ctx_flow_direction", "ctx_dwell_avg",
            "ctx_engagement", "ctx_attention", "crowd_trend", "density_trend", "engagement_trend", "stability",
            "peak_crowd", "peak_ratio", "is_peak")
_DBL = {"ctx_avg_density", "ctx_dwell_avg", "ctx_engagement", "ctx_attention", "peak_ratio", "peak_crowd"}


def _rc_select(cols):
    return ", ".join(f"round({c}, 6) as {c}" if c in _DBL else c for c in cols)


def _spark_rc(df, cols):
    return [round6(c).alias(c) if c in _DBL else F.col(c).cast("bigint").alias(c) if c == "n_recent" else F.col(c)
            for c in cols]


def _register_rc(name, cols, extra_sql="", extra_spark=()):
    sql = duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us"),
                   f"select frame_id, {_rc_select(cols)}{extra_sql} from rc")

    def q(spark, sf_dir):
        c = ctx_on(spark, sf_dir, "ts_us")
        return c.select("frame_id", *_spark_rc(c, cols), *[f() for f in extra_spark])

    register(name, sql)(q)



@register("recent_frames", duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us"), """
select frame_id, n_recent from rc"""))
def q_recent_frames(spark, sf_dir):
    """The window as a list."""
    r = CX.recent_frames(frames_on(spark, sf_dir, "ts_us"))
    return r.select("frame_id", F.size("recent").cast("bigint").alias("n_recent"))


_register_rc("context_aggregate", ("n_recent", "ctx_cluster_count", "ctx_avg_density", "ctx_dwell_avg",
                                   "ctx_engagement", "ctx_attention"))
_register_rc("dominant_flow", ("ctx_flow_direction",))
_register_rc("trend", ("crowd_trend", "density_trend", "engagement_trend"))
_register_rc("stability", ("stability",))
_register_rc("peaks", ("peak_crowd", "peak_ratio", "is_peak"), ", peak_ts_us",
             (lambda: US("peak_ts").alias("peak_ts_us"),))


def _register_hist(kind, compat=False):
    name = f"history_{kind}" + ("_compat" if compat else "")
    sql = duck_sql(["fx_base", "fx_frame"], duck_history(kind, "ts_us", compat), _HIST_SELECT.format(p=f"h_{kind}"))

    def q(spark, sf_dir):
        return _hist_out(CX.rolling_history(frames_on(spark, sf_dir, "ts_us"), kind, compat=compat))

    register(name, sql)(q)


for _k in CX.WINDOW_KINDS:
    _register_hist(_k)
_register_hist("immediate", compat=True)
_register_hist("short", compat=True)


# ----------------------------------------------------- baseline chain (raw clock)
def _duck_baseline() -> str:
    hist = ",\n".join(duck_history(k, "ts_us_raw") for k in CX.WINDOW_KINDS)
    union = " union all ".join(f"select * from h_{k}" for k in CX.WINDOW_KINDS)
    return f"""{duck_recent("ts_us_raw")},
{hist},
hall as ({union}),
hx as (select *, (ts_us // 86400000000 + 4) % 7 as dow, (ts_us // 3600000000) % 24 as hr,
  case window_type when 'immediate' then 0 when 'short' then 1 when 'medium' then 2 else 3 end as rnk from hall),
cx as (select *, (t // 86400000000 + 4) % 7 as dow, (t // 3600000000) % 24 as hr from rc),
jn as (select cx.frame_id, hx.* from cx join hx on hx.billboard_id = cx.billboard_id and hx.dow = cx.dow
  and abs(hx.hr - cx.hr) <= 1 and hx.ts_us < cx.t),
bd as (select frame_id, coalesce(flow_direction, 'unknown') as dir, count(*) as c,
  min({{'t': ts_us, 'r': rnk}}) as first from jn group by 1, 2),
bm as (select frame_id, arg_max(dir, {{'c': c, 'f': first}}) as base_flow_direction from bd group by 1),
ba as (select frame_id, count(*) as base_n,
  cast(sum(cast(round(cluster_count, 9) as decimal(38,12))) as double) / count(*) as base_cluster_count,
  cast(sum(cast(round(avg_density, 9) as decimal(38,12))) as double) / count(*) as base_avg_density,
  cast(sum(cast(round(dwell_avg, 9) as decimal(38,12))) as double) / count(*) as base_dwell_avg,
  cast(sum(cast(round(engagement, 9) as decimal(38,12))) as double) / count(*) as base_engagement
  from jn group by 1),
base as (select cx.*, ba.base_n, ba.base_cluster_count, ba.base_avg_density, ba.base_dwell_avg, ba.base_engagement,
  bm.base_flow_direction from cx left join ba on ba.frame_id = cx.frame_id left join bm on bm.frame_id = cx.frame_id),
an as (select *,
  case when base_n > 0 and ctx_cluster_count > base_cluster_count * 3.0 then 'crowd_surge' end as a1,
  case when base_n > 0 and ctx_dwell_avg > base_dwell_avg * 2.5 then 'unusual_dwell' end as a2,
  case when base_n > 0 and ctx_flow_direction <> base_flow_direction then 'flow_change' end as a3 from base)"""


def baseline_df(spark, sf_dir):
    fr = frames_on(spark, sf_dir, "ts_us_raw")
    ctx = CX.recent_context(fr)
    hist = CX.all_history(fr)
    return CX.historical_baseline(ctx, hist)


@register("historical_baseline", duck_sql(["fx_base", "fx_frame"], _duck_baseline(), """
select frame_id, base_n, round(base_cluster_count, 6) as base_cluster_count, round(base_avg_density, 6)
  as base_avg_density, round(base_dwell_avg, 6) as base_dwell_avg, round(base_engagement, 6) as base_engagement,
  base_flow_direction from base"""))
def q_historical_baseline(spark, sf_dir):
    b = baseline_df(spark, sf_dir)
    return b.select("frame_id", F.col("base_n").cast("bigint").alias("base_n"),
                    *[round6(c).alias(c) for c in ("base_cluster_count", "base_avg_density", "base_dwell_avg",
                                                     "base_engagement")], "base_flow_direction")


@register("detect_anomalies", duck_sql(["fx_base", "fx_frame"], _duck_baseline(), """
select frame_id, cast((a1 is not null)::int + (a2 is not null)::int + (a3 is not null)::int as integer) as n_anomalies,
  concat_ws(',', a1, a2, a3) as anomaly_types from an"""))
def q_detect_anomalies(spark, sf_dir):
    a = CX.detect_anomalies(baseline_df(spark, sf_dir))
    return a.select("frame_id", F.size("anomalies").alias("n_anomalies"),
                    F.array_join(F.transform("anomalies", lambda x: x["type"]), ",").alias("anomaly_types"))


@register("generate_insights", duck_sql(["fx_base", "fx_frame"], _duck_baseline() + """,
tod as (select *, case when (ts_us_raw // 3600000000) % 24 between 6 and 11 then 0.6
  when (ts_us_raw // 3600000000) % 24 between 12 and 16 then 0.8
  when (ts_us_raw // 3600000000) % 24 between 17 and 20 then 0.9 else 0.4 end as dens from an)""", """
select frame_id, concat_ws(',',
  case when ctx_cluster_count > 10 then 'high_traffic' when ctx_cluster_count < 2 then 'low_traffic' end,
  case when ctx_engagement > 0.7 then 'high_engagement' end,
  case when crowd_trend = 'increasing' then 'crowd_building' end,
  case when a1 is not null then 'anomaly_detected' end, case when a2 is not null then 'anomaly_detected' end,
  case when a3 is not null then 'anomaly_detected' end,
  case when ctx_cluster_count > dens * 15 then 'above_normal_traffic' end) as insight_types from tod"""))
def q_generate_insights(spark, sf_dir):
    a = CX.detect_anomalies(baseline_df(spark, sf_dir))
    g = CX.generate_insights(a, us_col="ts_us_raw")
    return g.select("frame_id", F.array_join(F.transform("insights", lambda x: x["type"]), ",").alias("insight_types"))


@register("anomaly_log", duck_sql(["fx_base", "fx_frame"], _duck_baseline(), """
select frame_id, anomaly_type, case anomaly_type when 'crowd_surge' then 'high' when 'unusual_dwell' then 'medium'
  else 'low' end as severity, case anomaly_type when 'crowd_surge' then 'switch_to_high_capacity_content'
  when 'unusual_dwell' then 'extend_current_content' else 'monitor_situation' end as action
from (select frame_id, a1 as anomaly_type from an where a1 is not null
  union all select frame_id, a2 from an where a2 is not null
  union all select frame_id, a3 from an where a3 is not null) x"""))
def q_anomaly_log(spark, sf_dir):
    a = CX.detect_anomalies(baseline_df(spark, sf_dir))
    return CX.anomaly_log(a, ("frame_id",)).select("frame_id", "anomaly_type", "severity", "action")


@register("context_snapshot", duck_sql(["fx_base", "fx_frame"], duck_recent("ts_us"), """
select billboard_id, (t // 5000000 + 1) * 5000000 as tick_us,
  arg_max({'f': frame_id, 'cc': ctx_cluster_count, 'fl': ctx_flow_direction}, {'t': t, 'f': frame_id}).f as frame_id,
  arg_max(ctx_cluster_count, {'t': t, 'f': frame_id}) as cluster_count,
  arg_max(ctx_flow_direction, {'t': t, 'f': frame_id}) as flow_direction,
  round(arg_max(ctx_engagement, {'t': t, 'f': frame_id}), 6) as engagement_score
from rc group by billboard_id, t // 5000000"""))
def q_context_snapshot(spark, sf_dir):
    c = ctx_on(spark, sf_dir, "ts_us")
    s = CX.context_snapshot(c, 5)
    return s.select("billboard_id", US("tick").alias("tick_us"), "frame_id", "cluster_count", "flow_direction",
                    round6("engagement_score").alias("engagement_score"))


# X11 with gaps filled and the whole payload: ticks of each billboard from its first to its last frame
DUCK_TICKS = """snap as (select billboard_id, (t // 5000000 + 1) * 5000000 as tick, arg_max(frame_id, {'t': t, 'f': frame_id}) as frame_id
  from rc group by 1, 2),
ends as (select billboard_id, min(tick) as t0, max(tick) as t1 from snap group by 1),
ticks as (select billboard_id, unnest(range(t0, t1 + 1, 5000000)) as tick from ends),
filled as (select ticks.billboard_id, ticks.tick, snap.frame_id, snap.tick <> ticks.tick as repeated
  from ticks asof join snap on snap.billboard_id = ticks.billboard_id and snap.tick <= ticks.tick)"""


def payload_context(spark, sf_dir):
    """Contexts with what the update payload carries besides: location, weather, demographics, privacy mode."""
    from footfall.operators import enrich as EN
    from footfall.operators.asof import asof_last
    from footfall.plans import inputs as I

    ctx = ctx_on(spark, sf_dir, "ts_us")
    modes = I.mode_log(spark, sf_dir).select("billboard_id", "ts", F.col("mode").alias("_m"), F.lit(0).alias("_kind"), "frame_id")
    both = ctx.withColumn("_kind", F.lit(1)).unionByName(modes, allowMissingColumns=True)
    ctx = asof_last(both, "billboard_id", "ts", ["ts", "_kind", "frame_id"], {"privacy_mode": F.col("_m")}).where("_kind = 1")
    ctx = EN.attach_weather(ctx.drop("_kind", "_m"), I.weather_obs(spark, sf_dir), key="billboard_id")
    n = F.substring("billboard_id", 4, 10).cast("double")
    return ctx.withColumn("weather_conditions", F.col("weather")).withColumn("estimated_groups", F.floor(F.col("total_people") / 3)) \
        .withColumn("demographic_confidence", F.col("engagement")) \
        .withColumn("location", F.struct((F.lit(40.0) + n).alias("lat"), (F.lit(-74.0) - n).alias("lng"), F.lit(0.0).alias("accuracy")))


def _duck_filled() -> str:
    from footfall.plans import inputs as I
    return f"""{duck_recent("ts_us")},
{DUCK_TICKS},
{I.DUCK_MODES},
{I.DUCK_WEATHER},
mode_at as (select billboard_id, ts_us, arg_max(mode, event_id) as mode from modes group by 1, 2),
rain_at as (select billboard_id, ts_us, max(condition) as condition from wobs group by 1, 2)"""


@register("context_snapshot_filled", duck_sql(["fx_base", "fx_frame"], _duck_filled(), """
select f.billboard_id, f.tick as tick_us, f.repeated, f.frame_id, rc.ctx_cluster_count as cluster_count,
  rc.ctx_flow_direction as flow_direction, round(rc.ctx_avg_density, 6) as avg_density, round(rc.ctx_dwell_avg, 6) as dwell_time_avg,
  round(rc.ctx_engagement, 6) as engagement_score, 40e0 + cast(substr(f.billboard_id, 4) as double) as lat,
  case when md.mode <> 'strict' then k.total_people // 3 end as estimated_groups, rn.condition as weather_conditions
from filled f join rc on rc.frame_id = f.frame_id join fx_frame k on k.frame_id = f.frame_id
  asof left join mode_at md on md.billboard_id = k.billboard_id and md.ts_us <= k.ts_us
  asof left join rain_at rn on rn.billboard_id = k.billboard_id and rn.ts_us <= k.ts_us"""))
def q_context_snapshot_filled(spark, sf_dir):
    s = CX.context_snapshot(payload_context(spark, sf_dir), 5, fill_gaps=True)
    return s.select("billboard_id", US("tick").alias("tick_us"), "repeated", "frame_id", "cluster_count", "flow_direction",
                    *[round6(c).alias(c) for c in ("avg_density", "dwell_time_avg", "engagement_score")],
                    F.col("location.lat").alias("lat"), F.col("demographic_inference.estimated_groups").alias("estimated_groups"),
                    F.col("environmental.weather_conditions").alias("weather_conditions"))
