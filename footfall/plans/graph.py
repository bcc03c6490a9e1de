"""Intent-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.operators import graph as G
from footfall.operators.governance import filter_live
from footfall.plans.inputs import AS_OF_US, DUCK_TTL, as_of, envelopes
from footfall.plans.inputs import DUCK_SESSION as I_SESSION
from footfall.plans.registry import register
from footfall.session import scratch_path
from footfall.sources.fixtures import duck_sql

US = F.unix_micros

# DuckDB twin of intent_edges over fx_envelope
DUCK_EDGES = f"""ev as (select *, {DUCK_TTL} as ttl from fx_envelope),
edges as (
  select uuid, event_type,
    case event_type when 'view_venue' then 'viewed' when 'favorite' then 'favorited' when 'search' then 'searched'
      when 'tag_interaction' then 'interacted:tag' when 'map_move' then 'map' end as relation,
    case event_type when 'view_venue' then 'venue' when 'favorite' then 'entity' when 'search' then 'query'
      when 'tag_interaction' then 'tag' when 'map_move' then 'area' end as target_type,
    case event_type when 'search' then lower(trim(concat('Query ', cast(k % 13 as varchar))))
      when 'tag_interaction' then concat('tag_', category) else entity_id end as target,
    case event_type when 'favorite' then 5e0 else 1e0 end as weight,
    category, ts_us, ts_us + cast(ttl as bigint) * 1000000 as expires_us
  from ev where event_type in ('view_venue', 'favorite', 'search', 'tag_interaction', 'map_move')
),
weights as (
  select uuid, relation, target_type, target, sum(weight) as weight, count(*) as n_edges,
    max(ts_us) as last_seen_us, arg_max(category, {{'t': ts_us, 'c': category}}) as category
  from edges where ts_us <= {AS_OF_US} and expires_us > {AS_OF_US}
  group by uuid, relation, target_type, target
)"""


def live_edges(spark, sf_dir):
    env = envelopes(spark, sf_dir)
    return G.intent_edges(env)


def live_weights(spark, sf_dir):
    return G.edge_weights(live_edges(spark, sf_dir), as_of())


@register("intent_edges", duck_sql(["fx_envelope"], DUCK_EDGES,
          "select uuid, event_type, relation, target_type, target, weight, category, ts_us, expires_us from edges"))
def q_intent_edges(spark, sf_dir):
    e = live_edges(spark, sf_dir)
    return e.select("uuid", "event_type", "relation", "target_type", "target", "weight", "category",
                    US("ts").alias("ts_us"), US("expires_at").alias("expires_us"))


@register("edge_weights", duck_sql(["fx_envelope"], DUCK_EDGES,
          "select uuid, relation, target_type, target, weight, n_edges, last_seen_us, category from weights"))
def q_edge_weights(spark, sf_dir):
    w = live_weights(spark, sf_dir)
    return w.select("uuid", "relation", "target_type", "target", round6("weight").alias("weight"), "n_edges",
                    US("last_seen").alias("last_seen_us"), "category")


@register("ttl_live", duck_sql(["fx_envelope"], f"ev as (select *, {DUCK_TTL} as ttl from fx_envelope)",
          f"select event_id, event_type, platform, ttl from ev where ts_us + cast(ttl as bigint) * 1000000 > {AS_OF_US}"))
def q_ttl_live(spark, sf_dir):
    env = envelopes(spark, sf_dir)
    return filter_live(env, as_of()).select("event_id", "event_type", "platform", "ttl")


def flagship(spark, sf_dir, k: int = 5):
    """Envelope -> TTL -> live filter -> intent edges -> weights -> top-k."""
    env = filter_live(envelopes(spark, sf_dir), as_of())
    w = G.edge_weights(G.intent_edges(env), as_of())
    top = G.adjacency_topk(w, k)
    return top.select("uuid", "rank", "relation", "target", round6("weight").alias("weight"))


@register("adjacency_topk", duck_sql(["fx_envelope"], DUCK_EDGES, """select * from (
  select uuid, cast(row_number() over (partition by uuid order by weight desc, relation, target) as integer) as rank,
    relation, target, round(weight, 6) as weight from weights) t where rank <= 5"""))
def q_adjacency_topk(spark, sf_dir):
    return flagship(spark, sf_dir, 5)


# ------------------------------------------------------------------ G4–G15
def scores_df(spark, sf_dir):
    return G.intent_score(live_weights(spark, sf_dir))


_SCORES = DUCK_EDGES + """,
sc as (select uuid, category, sum(weight) as weight, sum(weight) / sum(sum(weight)) over (partition by uuid) as score
  from weights group by uuid, category)"""


@register("intent_score", duck_sql(["fx_envelope"], _SCORES, """
select uuid, category, round(weight, 6) as weight, round(score, 6) as score from sc"""))
def q_intent_score(spark, sf_dir):
    s = scores_df(spark, sf_dir)
    return s.select("uuid", "category", round6("weight").alias("weight"), round6("score").alias("score"))


@register("intent_stage", duck_sql(["fx_envelope"], f"""
env as (select *, {I_SESSION} as session_id from fx_envelope)""", """
select uuid, entity_id, min(case when event_type in ('view_venue', 'view_event', 'view_content') then ts_us end)
  as first_view_us, case when max(case when event_type = 'share' then 1 else 0 end) = 1 then 'shared'
  when count(distinct event_type) >= 2 then 'explored' when count(distinct session_id) >= 2 then 'returned'
  when min(case when event_type in ('view_venue', 'view_event', 'view_content') then ts_us end) is not null
  then 'discovered' else 'touched' end as stage from env group by uuid, entity_id"""))
def q_intent_stage(spark, sf_dir):
    s = G.intent_stage(envelopes(spark, sf_dir))
    return s.select("uuid", "entity_id", US("first_view").alias("first_view_us"), "stage")


@register("audience_segment", duck_sql(["fx_envelope"], _SCORES, """
select uuid, arg_max(category, {'s': score, 'c': category}) as dominant_category, round(sum(weight), 6) as total_weight,
  case when sum(weight) >= 50 then 'heavy' when sum(weight) >= 20 then 'regular' when sum(weight) >= 5 then 'light'
  else 'casual' end as activity_tier from sc group by uuid"""))
def q_audience_segment(spark, sf_dir):
    a = G.audience_segment(scores_df(spark, sf_dir))
    return a.select("uuid", "dominant_category", round6("total_weight").alias("total_weight"), "activity_tier")


@register("intent_trigger", duck_sql(["fx_envelope"], """
e as (select event_id, uuid, ts_us, case event_type when 'add_to_cart' then 1e0 when 'checkout_started' then 2e0
  else 3e0 end as w from fx_envelope where event_type in ('add_to_cart', 'checkout_started', 'purchase')),
t as (select *, sum(w) over (partition by uuid order by ts_us range between 604799999999 preceding and current row)
  as tw from e),
l as (select *, lag(tw) over (partition by uuid order by ts_us, event_id) as ptw from t)""", """
select event_id, uuid, round(tw, 6) as trailing_weight, 'high_purchase_intent' as rule from l
where tw >= 3 and (ptw is null or ptw < 3)"""))
def q_intent_trigger(spark, sf_dir):
    t = G.intent_trigger(envelopes(spark, sf_dir), 3.0, 7)
    return t.select("event_id", "uuid", round6("trailing_weight").alias("trailing_weight"), "rule")


_CELL = "round({c} / 0.1) * 0.1"


@register("intent_heatmap", duck_sql(["fx_envelope"], "", f"""
select round({_CELL.format(c='lat')}, 6) as cell_lat, round({_CELL.format(c='lng')}, 6) as cell_lng,
  cast((ts_us // 3600000000) % 24 as bigint) as hour, category, count(*) as events, count(distinct uuid) as users
from fx_envelope group by 1, 2, 3, 4 having count(distinct uuid) >= 3"""))
def q_intent_heatmap(spark, sf_dir):
    h = G.heatmap(envelopes(spark, sf_dir), 3)
    return h.select(round6("cell_lat").alias("cell_lat"), round6("cell_lng").alias("cell_lng"), "hour", "category",
                    "events", "users")


@register("geo_trending", duck_sql(["fx_envelope"], f"""
g as (select ts_us // 86400000000 as d, {_CELL.format(c='lat')} as cell_lat, {_CELL.format(c='lng')} as cell_lng, category,
  count(*) as events from fx_envelope group by 1, 2, 3, 4),
l as (select *, lag(d) over w as pd, lag(events) over w as pe from g
  window w as (partition by cell_lat, cell_lng, category order by d)),
gr as (select *, case when pd = d - 1 then pe else 0 end as prev_events from l),
r as (select *, (events - prev_events) / prev_events as growth from gr where prev_events > 0),
k as (select *, row_number() over (partition by d order by growth desc, cell_lat, cell_lng, category) as rank from r)""",
          """
select d * 86400000000 as day_us, round(cell_lat, 6) as cell_lat, round(cell_lng, 6) as cell_lng, category, events,
  prev_events, round(growth, 6) as growth, cast(rank as integer) as rank from k where rank <= 3"""))
def q_geo_trending(spark, sf_dir):
    t = G.geo_trending(envelopes(spark, sf_dir), 3)
    return t.select(US("w.start").alias("day_us"), round6("cell_lat").alias("cell_lat"),
                    round6("cell_lng").alias("cell_lng"), "category", "events", "prev_events",
                    round6("growth").alias("growth"), "rank")


@register("cohort_retention", duck_sql(["fx_envelope"], """
e as (select uuid, cast(floor((ts_us / 86400000000e0 + 3) / 7) as bigint) as week from fx_envelope),
f as (select uuid, min(week) as cohort_week from e group by uuid)""", """
select cohort_week, e.week - cohort_week as week_offset, count(distinct e.uuid) as active_users
from e join f on f.uuid = e.uuid group by 1, 2"""))
def q_cohort_retention(spark, sf_dir):
    return G.cohort_retention(envelopes(spark, sf_dir))


FUNNEL_STEPS = ["view_venue", "add_to_cart", "share", "purchase"]


@register("funnel", duck_sql(["fx_envelope"], """
s1 as (select uuid, min(ts_us) as t1 from fx_envelope where event_type = 'view_venue' group by uuid),
s2 as (select s1.uuid, min(e.ts_us) as t2 from s1 join fx_envelope e on e.uuid = s1.uuid and e.event_type = 'add_to_cart'
  and e.ts_us > s1.t1 and e.ts_us <= s1.t1 + 604800000000 group by s1.uuid),
s3 as (select s1.uuid, min(e.ts_us) as t3 from s1 join s2 on s2.uuid = s1.uuid join fx_envelope e on e.uuid = s1.uuid
  and e.event_type = 'share' and e.ts_us > s2.t2 and e.ts_us <= s1.t1 + 604800000000 group by s1.uuid),
s4 as (select s1.uuid, min(e.ts_us) as t4 from s1 join s3 on s3.uuid = s1.uuid join fx_envelope e on e.uuid = s1.uuid
  and e.event_type = 'purchase' and e.ts_us > s3.t3 and e.ts_us <= s1.t1 + 604800000000 group by s1.uuid)""", """
select 1 as step_no, 'view_venue' as step, (select count(*) from s1) as users
union all select 2, 'add_to_cart', (select count(*) from s2)
union all select 3, 'share', (select count(*) from s3)
union all select 4, 'purchase', (select count(*) from s4)"""))
def q_funnel(spark, sf_dir):
    per = G.funnel(envelopes(spark, sf_dir), FUNNEL_STEPS, 7)
    return G.funnel_counts(per, FUNNEL_STEPS).select(F.col("step_no").cast("int").alias("step_no"), "step", "users")


@register("attribution_last_touch", duck_sql(["fx_envelope"], """
p as (select event_id, uuid, ts_us from fx_envelope where event_type = 'purchase'),
t as (select uuid, ts_us, utm_source from fx_envelope where utm_source is not null),
j as (select p.*, t.ts_us as tts, t.utm_source from p asof left join t on t.uuid = p.uuid and p.ts_us >= t.ts_us)""", """
select event_id, uuid, case when ts_us - tts <= 604800000000 then utm_source end as credited_source,
  case when ts_us - tts <= 604800000000 then tts end as touch_ts_us from j"""))
def q_attribution_last_touch(spark, sf_dir):
    a = G.attribution(envelopes(spark, sf_dir), 7, "last")
    return a.select("event_id", "uuid", "credited_source", US("touch_ts").alias("touch_ts_us"))


@register("attribution_first_touch", duck_sql(["fx_envelope"], """
r as (select * from fx_envelope where event_type = 'purchase' or utm_source is not null),
w as (select *, arg_min({'s': utm_source, 't': ts_us}, {'t': ts_us, 'e': event_id}) filter (where utm_source is not null)
  over (partition by uuid order by ts_us range between 604800000000 preceding and current row) as f from r)""", """
select event_id, uuid, f.s as credited_source, f.t as touch_ts_us from w where event_type = 'purchase'"""))
def q_attribution_first_touch(spark, sf_dir):
    a = G.attribution(envelopes(spark, sf_dir), 7, "first")
    return a.select("event_id", "uuid", "credited_source", US("touch_ts").alias("touch_ts_us"))


@register("attribution_linear", duck_sql(["fx_envelope"], """
t as (select p.event_id, p.uuid, u.utm_source as credited_source, count(*) as touches from fx_envelope p join fx_envelope u
  on u.uuid = p.uuid and u.utm_source is not null and u.ts_us <= p.ts_us and u.ts_us >= p.ts_us - 604800000000
  where p.event_type = 'purchase' group by 1, 2, 3)""", """
select event_id, uuid, credited_source, touches, round(touches / sum(touches) over (partition by event_id), 6) as credit from t"""))
def q_attribution_linear(spark, sf_dir):
    a = G.attribution(envelopes(spark, sf_dir), 7, "linear")
    return a.select("event_id", "uuid", "credited_source", F.col("touches").cast("bigint").alias("touches"), round6("credit").alias("credit"))


@register("lookalike", duck_sql(["fx_envelope"], _SCORES + """,
seeds as (select distinct uuid from fx_envelope where event_type = 'purchase' and amount > 200),
ss as (select * from sc where uuid in (select uuid from seeds)),
mean as (select category, sum(score) / (select count(distinct uuid) from ss) as m from ss group by category),
cand as (select * from sc where uuid not in (select uuid from seeds)),
dots as (select c.uuid, sum(c.score * coalesce(m.m, 0)) as dot, sqrt(sum(c.score * c.score)) as nu
  from cand c left join mean m on m.category = c.category group by c.uuid)""", """
select uuid, round(dot / (nu * (select sqrt(sum(m * m)) from mean)), 6) as similarity from dots
order by dot / (nu * (select sqrt(sum(m * m)) from mean)) desc, uuid limit 10"""))
def q_lookalike(spark, sf_dir):
    env = envelopes(spark, sf_dir)
    seeds = env.where((F.col("event_type") == "purchase") & (F.col("context")["amount"].cast("double") > 200))
    lk = G.lookalike(scores_df(spark, sf_dir), seeds, 10)
    return lk.select("uuid", round6("similarity").alias("similarity"))


@register("lookalike_signatures", duck_sql(["fx_envelope"], _SCORES + """,
seeds as (select distinct uuid from fx_envelope where event_type = 'purchase' and amount > 200),
ss as (select * from sc where uuid in (select uuid from seeds)),
planes as (select category, i, bit_count(cast('0x' || substr(md5(i || ':' || coalesce('c:' || category, 'n')), 1, 15) as bigint)) - 30 as w
  from (select distinct category from sc), range(128) r(i)),
sums as (select uuid, i, sum(cast(round(score * 1e9) as bigint) * w) >= 0 as side
  from sc join planes using (category) group by uuid, i),
mean_sums as (select i, sum(cast(round(score * 1e9) as bigint) * w) >= 0 as side from ss join planes using (category) group by i),
alike as (select distinct uuid from (select uuid from sums join mean_sums using (i)
  group by uuid, i // 8 having bool_and(sums.side = mean_sums.side))),
mean as (select category, sum(score) / (select count(distinct uuid) from ss) as m from ss group by category),
cand as (select * from sc where uuid not in (select uuid from seeds) and uuid in (select uuid from alike)),
dots as (select c.uuid, sum(c.score * coalesce(m.m, 0)) as dot, sqrt(sum(c.score * c.score)) as nu
  from cand c left join mean m on m.category = c.category group by c.uuid)""", """
select uuid, round(dot / (nu * (select sqrt(sum(m * m)) from mean)), 6) as similarity from dots
order by dot / (nu * (select sqrt(sum(m * m)) from mean)) desc, uuid limit 10"""))
def q_lookalike_signatures(spark, sf_dir):
    env = envelopes(spark, sf_dir)
    seeds = env.where((F.col("event_type") == "purchase") & (F.col("context")["amount"].cast("double") > 200))
    scores = scores_df(spark, sf_dir)
    index = G.signature_index(G.category_signatures(scores), scratch_path(spark, "signatures"))
    return G.lookalike_by_signature(scores, seeds, index, 10).select("uuid", round6("similarity").alias("similarity"))


_HOURS = ", ".join(f'count(*) filter (where hr = {h}) as "{h}"' for h in range(24))


@register("temporal_profile", duck_sql(["fx_envelope"], """
e as (select category, case when (ts_us // 86400000000 + 4) % 7 in (0, 6) then 'weekend' else 'weekday' end as day_type,
  (ts_us // 3600000000) % 24 as hr from fx_envelope)""", f"""
select category, day_type, {_HOURS} from e group by category, day_type"""))
def q_temporal_profile(spark, sf_dir):
    return G.temporal_profile(envelopes(spark, sf_dir))
