"""Governance and enrichment queries: P6–P8, P11, P12, J1–J9."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.operators import enrich as EN
from footfall.operators import governance as GV
from footfall.operators.asof import asof_last
from footfall.operators.envelope import pseudonymise
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.sources import fixtures as fx
from footfall.sources.fixtures import duck_sql

US = F.unix_micros


def consent_log(spark, sf_dir):
    return fx.fx_consent(spark, sf_dir).select("uuid", I.ts_of("ts_us").alias("ts"), "change")


_CONSENT_AT = ("coalesce((select arg_max(c.change, c.ts_us) from fx_consent c "
               "where c.uuid = {t}.uuid and c.ts_us <= {t}.{ts}), 'opt_in')")


@register("consent_filter", duck_sql(["fx_envelope", "fx_consent"], "", f"""
select e.event_id, e.uuid, e.event_type, e.ts_us from fx_envelope e
where {_CONSENT_AT.format(t='e', ts='ts_us')} <> 'opt_out'"""))
def q_consent_filter(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    kept = GV.apply_consent(env, consent_log(spark, sf_dir))
    return kept.select("event_id", "uuid", "event_type", US("ts").alias("ts_us"))


@register("consent_filter_strict", duck_sql(["fx_envelope", "fx_consent"], f"""
env as (select *, {I.DUCK_SESSION} as session_id from fx_envelope),
sess as (select uuid, session_id, min(ts_us) as s0 from env group by uuid, session_id),
blocked as (select s.uuid, s.session_id from sess s where {_CONSENT_AT.format(t='s', ts='s0')} = 'opt_out')""", f"""
select e.event_id, e.uuid, e.event_type, e.ts_us from env e
where {_CONSENT_AT.format(t='e', ts='ts_us')} <> 'opt_out'
  and not exists (select 1 from blocked b where b.uuid = e.uuid and b.session_id = e.session_id)"""))
def q_consent_filter_strict(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    kept = GV.apply_consent(env, consent_log(spark, sf_dir), strict_restart=True)
    return kept.select("event_id", "uuid", "event_type", US("ts").alias("ts_us"))


@register("optout_purge", duck_sql(["fx_envelope", "fx_consent"], "", """
select e.event_id, e.uuid, e.ts_us, e.ingest_us from fx_envelope e
where not exists (select 1 from fx_consent c where c.uuid = e.uuid and c.change = 'opt_out'
  and e.ts_us <= c.ts_us and c.ts_us < e.ingest_us)"""))
def q_optout_purge(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    kept = GV.purge_on_optout(env, consent_log(spark, sf_dir))
    return kept.select("event_id", "uuid", US("ts").alias("ts_us"), US("ingest_ts").alias("ingest_us"))


@register("erase_users", duck_sql(["fx_envelope", "fx_consent"], "", """
select e.event_id, e.uuid from fx_envelope e
where e.uuid not in (select uuid from fx_consent where change = 'opt_out')"""))
def q_erase_users(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    ids = consent_log(spark, sf_dir).where(F.col("change") == "opt_out").select("uuid")
    return GV.erase_users(env, ids).select("event_id", "uuid")


@register("dedup_events", duck_sql(["fx_envelope"], "", """
select event_id, uuid, event_type, ts_us, ingest_us from fx_envelope"""))
def q_dedup_events(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    dups = env.where(F.col("k") % 7 == 0).withColumn("ingest_ts", F.timestamp_add("SECOND", F.lit(60),
                                                                                  F.col("ingest_ts")))
    once = GV.dedup(env.unionByName(dups), "event_id", "ingest_ts")
    return once.select("event_id", "uuid", "event_type", US("ts").alias("ts_us"), US("ingest_ts").alias("ingest_us"))


_MODE_AT = ("coalesce((select arg_max(m.mode, m.ts_us) from modes m where m.billboard_id = f.billboard_id "
            "and m.ts_us <= f.ts_us), 'strict')")


@register("privacy_retention", duck_sql(["fx_base", "fx_frame"], f"""{I.DUCK_MODES},
fm as (select f.*, {_MODE_AT} as mode from fx_frame f),
clr as (select billboard_id, max(ts_us) as clear_ts from modes where mode = 'strict' and ts_us <= {I.FRAME_AS_OF_US}
  group by billboard_id)""", f"""
select fm.frame_id, fm.billboard_id, fm.mode, fm.ts_us from fm left join clr on clr.billboard_id = fm.billboard_id
where fm.ts_us <= {I.FRAME_AS_OF_US}
  and fm.ts_us + cast(case fm.mode when 'strict' then 300 when 'balanced' then 1800 else 3600 end as bigint) * 1000000
      > {I.FRAME_AS_OF_US}
  and (clr.clear_ts is null or fm.ts_us >= clr.clear_ts)"""))
def q_privacy_retention(spark, sf_dir):
    as_of = F.timestamp_micros(F.lit(I.FRAME_AS_OF_US))
    fr = I.frames(spark, sf_dir).where(F.col("ts") <= as_of)
    held = GV.retention(fr, I.mode_log(spark, sf_dir), as_of)
    return held.select("frame_id", "billboard_id", "mode", US("ts").alias("ts_us"))


@register("privacy_projection", duck_sql(["fx_base", "fx_frame"], f"""{I.DUCK_MODES},
fm as (select f.*, {_MODE_AT} as mode from fx_frame f)""", """
select frame_id, mode, round(case when mode = 'minimal' then engagement else 0 end, 6) as engagement,
  round(case when mode = 'minimal' then attention else 0 end, 6) as attention, false as face_detection from fm"""))
def q_privacy_projection(spark, sf_dir):
    fr = I.frames(spark, sf_dir)
    modes = I.mode_log(spark, sf_dir)
    u = fr.withColumn("_kind", F.lit(1)).unionByName(
        modes.select("billboard_id", "ts", F.col("mode").alias("_m"), F.lit(0).alias("_kind"), "frame_id"),
        allowMissingColumns=True)
    got = asof_last(u, "billboard_id", "ts", ["ts", "_kind", "frame_id"], {"mode": F.col("_m")}) \
        .where(F.col("_kind") == 1).withColumn("mode", F.coalesce("mode", F.lit("strict")))
    out = GV.privacy_project(got, F.col("mode"), demographics_on=True)
    return out.select("frame_id", "mode", round6("engagement").alias("engagement"),
                      round6("attention").alias("attention"), "face_detection")


@register("redact_context", duck_sql(["fx_envelope"], "", """
select event_id, case when event_type = 'search' then concat('q:', substr(sha256(concat('s3cret',
    lower(trim(concat('Query ', cast(k % 13 as varchar)))))), 1, 16)) end as query_token,
  case when event_type <> 'share' then category end as category,
  case when event_type <> 'share' then 'Write to [email] or [phone]' end as element_text,
  cast(k % 4 as varchar) as field_count from fx_envelope"""))
def q_redact_context(spark, sf_dir):
    """All events: searches, free text in every context, and shares sent as forms."""
    env = I.envelopes(spark, sf_dir)
    k = F.col("k").cast("string")
    typed = F.create_map(F.lit("element_text"), F.concat(F.lit("Write to u"), k, F.lit("@example.com or +1 555 0100 2345")),
                         F.lit("field_count"), (F.col("k") % 4).cast("string"))
    env = env.withColumn("context", F.map_concat("context", typed)).withColumn(
        "event_type", F.when(F.col("event_type") == "share", "form_interaction").otherwise(F.col("event_type")))
    ctx = F.col("context")
    return GV.redact_pii(env, salt="s3cret").select(
        "event_id", ctx["search_query"].alias("query_token"), ctx["category"].alias("category"),
        ctx["element_text"].alias("element_text"), ctx["field_count"].alias("field_count"))


@register("redact_allowlist", duck_sql(["fx_envelope"], "", """
select event_id,
  case when k % 3 = 0 then 'https://x.test/p' end as url, case when k % 3 = 0 then 'About [email]' end as title,
  case when k % 3 = 0 then 'https://from.test/a' end as referrer,
  case when k % 3 = 1 then 'call [phone]' end as error_message, case when k % 3 = 1 then cast(k % 50 as varchar) end as error_line,
  category, cast(case k % 3 when 0 then 4 when 1 then 3 else 1 end as integer) as n_keys from fx_envelope"""))
def q_redact_allowlist(spark, sf_dir):
    """Page views, script errors and an unknown family, all with the same context: keys of other families, unknown
    keys, an address's query, and text where a number belongs do not pass."""
    env, k = I.envelopes(spark, sf_dir), F.col("k")
    mail, phone = "joe@example.com", "+1 555 0100 2345"
    sent = {"url": f"https://x.test/p?mail={mail}#top", "title": f"About {mail}", "referrer": f"https://from.test/a?tel={phone}",
            "search": f"?q={mail}", "hash": f"#{mail}", "error_message": f"call {phone}", "secret_note": f"{mail} wrote"}
    ctx = F.create_map(*[F.lit(x) for kv in sent.items() for x in kv], F.lit("error_line"), (k % 50).cast("string"),
                       F.lit("error_column"), F.lit(mail), F.lit("category"), F.col("context")["category"])
    family = F.when(k % 3 == 0, "view_content").when(k % 3 == 1, "javascript_error").otherwise("made_up_family")
    out = GV.redact_pii(env.withColumn("event_type", family).withColumn("context", ctx)).withColumn(
        "context", F.map_filter("context", lambda n, v: v.isNotNull()))
    c = F.col("context")
    return out.select("event_id", *[c[x].alias(x) for x in ("url", "title", "referrer", "error_message", "error_line", "category")],
                      F.size("context").alias("n_keys"))


@register("pseudonymise", duck_sql(["fx_envelope"], "", """
select event_id, concat('anon-', sha256(concat('salt-1', uuid))) as anon_key from fx_envelope"""))
def q_pseudonymise(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    return pseudonymise(env, "uuid", "salt-1", out="anon_key").select("event_id", "anon_key")


@register("asof_geo", duck_sql(["fx_envelope"], """
fixes as (select uuid, ts_us, lat, lng from fx_envelope where event_type = 'map_move'),
j as (select e.event_id, e.uuid, e.platform, e.ts_us, e.lat as elat, e.lng as elng, f.ts_us as fts, f.lat as flat,
  f.lng as flng from fx_envelope e asof left join fixes f on e.uuid = f.uuid and e.ts_us >= f.ts_us)""", """
select event_id, uuid,
  case when platform in ('ios', 'android') then elat when ts_us - fts <= 86400000000 then flat end as lat,
  case when platform in ('ios', 'android') then elng when ts_us - fts <= 86400000000 then flng end as lng,
  case when platform in ('ios', 'android') then 'explicit' when ts_us - fts <= 86400000000 then 'fix' end as geo_source
from j"""))
def q_asof_geo(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    ev = env.withColumn("geo", F.when(F.col("platform").isin("ios", "android"), F.col("geo")))
    fixes = env.where(F.col("event_type") == "map_move").select(
        "uuid", "ts", F.col("geo.lat").alias("lat"), F.col("geo.lng").alias("lng"),
        F.lit(None).cast("double").alias("accuracy"))
    got = EN.attach_geo(ev, fixes, max_age_s=86400)
    return got.select("event_id", "uuid", F.col("geo.lat").alias("lat"), F.col("geo.lng").alias("lng"), "geo_source")


@register("static_location", duck_sql(["fx_base", "fx_play"], """
devices as (select distinct concat('dev_', cast(user_id as varchar)) as device_id, 40e0 + (user_id % 10) / 10e0 as lat,
  -74e0 + (user_id % 7) / 10e0 as lng from fx_base)""", """
select p.event_id, p.device_id, d.lat, d.lng, 0e0 as accuracy from fx_play p left join devices d
  on d.device_id = p.device_id"""))
def q_static_location(spark, sf_dir):
    play = fx.fx_play(spark, sf_dir).withColumn("ts", I.ts_of("ts_us"))
    devices = fx.fx_base(spark, sf_dir).select(
        F.concat(F.lit("dev_"), F.col("user_id").cast("string")).alias("device_id"),
        (F.lit(40.0) + (F.col("user_id") % 10) / F.lit(10.0)).alias("lat"),
        (F.lit(-74.0) + (F.col("user_id") % 7) / F.lit(10.0)).alias("lng"),
    ).distinct()
    got = EN.attach_static_location(play, devices)
    return got.select("event_id", "device_id", F.col("geo.lat").alias("lat"), F.col("geo.lng").alias("lng"),
                      F.col("geo.accuracy").alias("accuracy"))


@register("thin_locations", duck_sql(["fx_envelope"], f"""
env as (select *, {I.DUCK_SESSION} as session_id from fx_envelope),
l as (select event_id, uuid, lat, lng, lag(lat) over w as plat, lag(lng) over w as plng, lag(event_id) over w as pid
  from env window w as (partition by uuid, session_id order by ts_us, event_id))""", """
select event_id, uuid from l where pid is null or plat <> lat or plng <> lng"""))
def q_thin_locations(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    fixes = env.select("event_id", "uuid", "session_id", "ts", F.col("geo.lat").alias("lat"),
                       F.col("geo.lng").alias("lng"))
    return EN.thin_locations(fixes, 100.0).select("event_id", "uuid")


def _thinned(distance: float, wait_s: int) -> str:
    """J7 by recursion: each fix against the last kept one of its session."""
    take = f"""(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - r.klat) / 2), 2)
    + cos(radians(r.klat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - r.klng) / 2), 2)))) >= {distance}
    and s.ts_us - r.kts >= {wait_s * 1_000_000})"""
    return duck_sql(["fx_envelope"], f"""
s as (select event_id, uuid, ts_us, 40e0 + (k % 10) * 0.0004e0 as lat, -74e0 + (k % 7) * 0.0005e0 as lng,
  row_number() over (partition by uuid, ts_us // 604800000000 order by ts_us, event_id) as rn, ts_us // 604800000000 as week from fx_envelope),
r as (select event_id, uuid, week, rn, lat as klat, lng as klng, ts_us as kts, true as kept from s where rn = 1
  union all select s.event_id, s.uuid, s.week, s.rn, case when {take} then s.lat else r.klat end,
    case when {take} then s.lng else r.klng end, case when {take} then s.ts_us else r.kts end, {take}
  from r join s on s.uuid = r.uuid and s.week = r.week and s.rn = r.rn + 1)""", """
select event_id, uuid from r where kept""", recursive=True)


def _register_thinned(name: str, distance: float, wait_s: int) -> None:
    @register(name, _thinned(distance, wait_s))
    def q(spark, sf_dir):
        """Moves of 0 to 500 m in steps of 44 and 43 m, so many lie under the distance; a session is a user's week."""
        env = I.envelopes(spark, sf_dir)
        fixes = env.select("event_id", "uuid", F.floor(US("ts") / F.lit(604800000000)).alias("session_id"), "ts",
                           (F.lit(40.0) + (F.col("k") % 10) * F.lit(0.0004)).alias("lat"),
                           (F.lit(-74.0) + (F.col("k") % 7) * F.lit(0.0005)).alias("lng"))
        return EN.thin_locations(fixes, distance, wait_s).select("event_id", "uuid")


_register_thinned("thin_locations_steps", 150.0, 0)
_register_thinned("thin_locations_interval", 100.0, 14400)


@register("asof_content", duck_sql(["fx_play"], """
m as (select *, case event_type when 'content_start' then content_id when 'content_end' then '' end as mk from fx_play),
f as (select *, last_value(mk ignore nulls) over (partition by device_id order by ts_us, event_id
  rows between unbounded preceding and current row) as cur from m)""", """
select event_id, device_id, nullif(cur, '') as current_content from f where event_type = 'interaction'"""))
def q_asof_content(spark, sf_dir):
    play = fx.fx_play(spark, sf_dir).withColumn("ts", I.ts_of("ts_us"))
    got = EN.content_at_interaction(play)
    return got.select("event_id", "device_id", "current_content")


@register("weather_join", duck_sql(["fx_base", "fx_frame"], f"""{I.DUCK_WEATHER},
u as (select billboard_id, ts_us, 1 as kind, frame_id, null as cond, cluster_count from fx_frame
  union all select billboard_id, ts_us, 0 as kind, null as frame_id, condition as cond, null from wobs),
w as (select *, last_value(cond ignore nulls) over (partition by billboard_id order by ts_us, kind, frame_id
  rows between unbounded preceding and current row) as weather from u)""", """
select frame_id, weather,
  case coalesce(weather, 'cloudy') when 'sunny' then 1.2e0 when 'cloudy' then 1.0e0 when 'rainy' then 0.6e0
    else 0.4e0 end as crowd_multiplier,
  round(cluster_count * case coalesce(weather, 'cloudy') when 'sunny' then 1.2e0 when 'cloudy' then 1.0e0
    when 'rainy' then 0.6e0 else 0.4e0 end, 6) as adjusted_crowd
from w where kind = 1"""))
def q_weather_join(spark, sf_dir):
    fr = I.frames(spark, sf_dir)
    got = EN.attach_weather(fr, I.weather_obs(spark, sf_dir), key="billboard_id")
    return got.select("frame_id", "weather", "crowd_multiplier",
                      round6(F.col("cluster_count") * F.col("crowd_multiplier")).alias("adjusted_crowd"))
