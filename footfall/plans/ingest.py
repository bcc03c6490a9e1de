"""Ingest and envelope queries: S1, S3–S5, P1, P3–P5, P9, P10, P13.

Raw client records are derived from the events table in the dialect of
each platform (web / React Native: ISO time, ``geo{lat,lng}``, JSON tags;
iOS: epoch seconds, ``geo_context{latitude,longitude}``, tags only in the
context; Android: ISO local time with a literal Z, string coordinates,
comma tags; Node: no entity id, no tags), shipped as upload-batch JSON and
parsed back — so the parsers and normalisers run on all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import envelope as EV
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.session import scratch_path
from footfall.sources import fixtures as fx
from footfall.sources import lookups as L
from footfall.sources import uploads as UP
from footfall.sources.fixtures import duck_sql
from footfall.sources.schema import RAW_EVENT

US = F.unix_micros


def raw_events(spark, sf_dir):
    I.ensure_utc(spark)
    e = fx.fx_envelope(spark, sf_dir)
    p, us = F.col("platform"), F.col("ts_us")
    ts = F.timestamp_micros(us)
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    secs = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    lat, lng = F.col("lat").cast("string"), F.col("lng").cast("string")
    native = p.isin("ios", "android")
    geo = F.when(~native, F.struct(lat.alias("lat"), lng.alias("lng"), *[F.lit(None).cast("string").alias(x) for x in
                                                                          ("latitude", "longitude", "accuracy",
                                                                           "timestamp")]))
    geo_ctx = F.when(native, F.struct(F.lit(None).cast("string").alias("lat"), F.lit(None).cast("string").alias("lng"),
                                      lat.alias("latitude"), lng.alias("longitude"),
                                      F.lit(None).cast("string").alias("accuracy"),
                                      F.lit(None).cast("string").alias("timestamp")))
    tags = F.when(p.isin("web", "react-native"), F.concat(F.lit('["'), F.col("category"), F.lit('"]'))) \
        .when(p == "ios", F.lit("[]")).when(p == "android", F.col("category"))
    ctx = F.create_map(F.lit("category"), F.col("category"), F.lit("venue_id"), F.col("entity_id"),
                       F.lit("tags"), F.when(p == "ios", F.col("category")))
    ev = F.struct(
        F.col("event_id").alias("event_id"), F.col("event_type").alias("event_type"),
        F.when(p != "node", F.col("entity_id")).alias("entity_id"),
        F.when(p == "ios", secs).otherwise(iso).alias("timestamp"),
        F.col("uuid").alias("uuid"), F.lit(None).cast("string").alias("anon_user_id"),
        F.concat(F.col("uuid"), F.lit("-s")).alias("session_id"), F.lit(None).cast("string").alias("client_id"),
        p.alias("platform"), F.lit(None).cast("string").alias("device_id"),
        F.lit(None).cast("string").alias("location_id"), ctx.alias("context"), geo.alias("geo"),
        geo_ctx.alias("geo_context"), tags.alias("tags"), F.lit(None).cast("int").alias("ttl"),
    ).cast(RAW_EVENT)
    return e.select(F.concat(F.lit("client-"), p).alias("client_id"), "uuid", ts.alias("ts"), F.col("event_id"),
                    ev.alias("e"))


def upload_text(spark, sf_dir):
    """S5 then to JSON text: the upload bodies a collector receives."""
    r = raw_events(spark, sf_dir)
    batches = UP.export_batches(r.select("client_id", "uuid", "ts", "event_id", F.col("e").alias("raw")), n=50)
    return batches


@register("export_batches", duck_sql(["fx_envelope"], """
b as (select 'client-' || platform as client_id, uuid as queue,
  (row_number() over (partition by platform, uuid order by ts_us, event_id) - 1) // 50 as batch_no
  from fx_envelope)""", """
select client_id, queue, batch_no, cast(count(*) as integer) as n_events from b group by 1, 2, 3"""))
def q_export_batches(spark, sf_dir):
    return upload_text(spark, sf_dir).select("client_id", "queue", "batch_no", "n_events")


def parsed_raw(spark, sf_dir):
    """S1 over the exported bodies: parse, explode, batch keys fill in."""
    return UP.parse_upload_batches(upload_bodies(spark, sf_dir), "value")


def upload_bodies(spark, sf_dir):
    """Upload bodies as collectors get them, the n-th of a queue received n minutes after the epoch of the tables."""
    text = upload_text(spark, sf_dir).select(F.col("payload").alias("value"), "batch_no")
    parsed = text.select("batch_no", F.from_json("value", "struct<client_id:string,events:array<struct<raw:"
                                                 + RAW_EVENT.simpleString() + ">>>").alias("b"))
    return parsed.select(F.to_json(F.struct(F.col("b.client_id").alias("client_id"),
                                            F.transform("b.events", lambda x: x["raw"]).alias("events")))
                         .alias("value"),
                         F.timestamp_micros(F.lit(fx.EPOCH_2024_US) + F.col("batch_no") * 60_000_000).alias("received_at"))


def upload_lines(spark, sf_dir):
    """Upload bodies and, for every batch, one line cut short or one without events."""
    good = upload_bodies(spark, sf_dir).select("value")
    cut = good.select(F.when(F.pmod(F.xxhash64("value"), F.lit(2)) == 0, F.substr("value", F.lit(1), F.lit(40)))
                      .otherwise(F.lit('{"client_id":"client-x"}')).alias("value"))
    return good.unionByName(cut)


def _both_sides(events, rejects):
    """Events by client and rejected lines, as one report."""
    good = events.groupBy(F.col("client_id").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))
    bad = rejects.agg(F.count("*").alias("n"), F.count(UP.CORRUPT).alias("n_ids")).withColumn("source", F.lit("rejected"))
    return good.unionByName(bad)


_UPLOAD_SIDES = duck_sql(["fx_envelope"], """
b as (select platform, uuid, (row_number() over (partition by platform, uuid order by ts_us, event_id) - 1) // 50 as batch_no
  from fx_envelope),
lines as (select count(*) as n from (select distinct platform, uuid, batch_no from b))""", """
select 'client-' || platform as source, count(*) as n, count(distinct event_id) as n_ids from fx_envelope group by platform
union all select 'rejected', n, n from lines""")


@register("upload_files", _UPLOAD_SIDES)
def q_upload_files(spark, sf_dir):
    """The same bodies through JSON files; good and rejected lines together are all lines."""
    folder = scratch_path(spark, "uploads")
    upload_lines(spark, sf_dir).write.text(folder)
    events, rejects = UP.read_upload_batches(spark, folder)
    return _both_sides(events, rejects)


@register("stream_upload_sides", _UPLOAD_SIDES)
def q_stream_upload_sides(spark, sf_dir):
    """The same files as a stream with two idempotent sinks, four files a micro-batch."""
    folder, out = scratch_path(spark, "uploads"), scratch_path(spark, "uploads-out")
    upload_lines(spark, sf_dir).repartition(8).write.text(folder)
    lines = UP.stream_upload_text(spark, folder, max_files_per_trigger=4)
    q = lines.writeStream.option("checkpointLocation", f"{out}/ck").trigger(availableNow=True) \
        .foreachBatch(UP.route_uploads(f"{out}/events", f"{out}/rejects")).start()
    q.awaitTermination()
    return _both_sides(spark.read.parquet(f"{out}/events"), spark.read.parquet(f"{out}/rejects"))


@register("ingest_envelope", duck_sql(["fx_envelope"], "", """
select event_id, event_type, 'client-' || platform as client_id, platform from fx_envelope"""))
def q_ingest_envelope(spark, sf_dir):
    return parsed_raw(spark, sf_dir).select("event_id", "event_type", "client_id", "platform")


@register("normalize_envelope", duck_sql(["fx_envelope"], "", """
select event_id, 1704067200000000 + 60000000 * ((row_number() over (partition by platform, uuid order by ts_us, event_id) - 1) // 50)
  as ingest_us, entity_id, case when platform = 'ios' then ts_us else ts_us - ts_us % 1000 end as ts_us, uuid,
  platform, lat, lng, case when platform = 'node' then '' else category end as tags_csv,
  platform = 'android' as ts_suspect from fx_envelope"""))
def q_normalize_envelope(spark, sf_dir):
    n = EV.normalize_envelope(parsed_raw(spark, sf_dir))
    return n.select("event_id", US("ingest_ts").alias("ingest_us"), "entity_id", US("ts").alias("ts_us"), "uuid", "platform",
                    F.col("geo.lat").alias("lat"), F.col("geo.lng").alias("lng"),
                    F.array_join("tags", ",").alias("tags_csv"), "ts_suspect")


@register("device_clock", duck_sql(["fx_envelope"], "", """
select event_id, case when platform = 'android' and k % 2 = 0 then ts_us - 19800000000 else ts_us end as ts_us,
  platform = 'android' and k % 2 <> 0 as ts_suspect from fx_envelope"""))
def q_device_clock(spark, sf_dir):
    """Android stamps are local time; half of the devices tell their zone (five and a half hours east)."""
    env = I.envelopes(spark, sf_dir).withColumn("ts_suspect", F.col("platform") == "android") \
        .withColumn("device_tz", F.when(F.col("k") % 2 == 0, "Asia/Kolkata"))
    return EV.fix_device_clock(env).select("event_id", US("ts").alias("ts_us"), "ts_suspect")


@register("entity_id", duck_sql(["fx_envelope"], "", """
select event_id, coalesce(nullif(case k % 4 when 0 then '' when 1 then null else entity_id end, ''),
  nullif(case k % 3 when 0 then '' else 'v' || cast(k as varchar) end, ''), nullif('e' || cast(k as varchar), ''))
  as entity_id from fx_envelope"""))
def q_entity_id(spark, sf_dir):
    e = fx.fx_envelope(spark, sf_dir)
    k = F.col("k")
    ctx = F.create_map(
        F.lit("entity_id"), F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit(None)).otherwise(F.col("entity_id")),
        F.lit("venue_id"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), k.cast("string"))),
        F.lit("event_id"), F.concat(F.lit("e"), k.cast("string")))
    return e.select("event_id", EV.entity_id_expr(ctx).alias("entity_id"))


def dialect_types(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    p, t = F.col("platform"), F.col("event_type")
    raw = (F.when((p == "ios") & (t == "view_venue"), "venue_view")
           .when(p.isin("ios", "android") & (t == "map_move"), "map_interaction")
           .when((p == "web") & (t == "view_venue"), "page_view")
           .when((p == "node") & (t == "javascript_error"), "error")
           .otherwise(t))
    return env.withColumn("event_type", raw)


_CORE = "', '".join(sorted(set(L.CORE_EVENT_TYPES) | set(L.NODE_EVENT_TYPES)))


@register("canonical_type", duck_sql(["fx_envelope"], """
d as (select *, case when platform = 'ios' and event_type = 'view_venue' then 'venue_view'
  when platform in ('ios', 'android') and event_type = 'map_move' then 'map_interaction'
  when platform = 'web' and event_type = 'view_venue' then 'page_view'
  when platform = 'node' and event_type = 'javascript_error' then 'error' else event_type end as raw from fx_envelope),
c as (select *, case raw when 'venue_view' then 'view_venue' when 'page_view' then 'view_content'
  when 'map_interaction' then (case k % 5 when 0 then 'map_move' when 1 then 'map_zoom' when 2 then 'map_filter'
    when 3 then 'map_center' else 'map_move' end) else raw end as canon from d)""", f"""
select event_id, raw as raw_event_type, canon as event_type, canon in ('{_CORE}') as is_core from c"""))
def q_canonical_type(spark, sf_dir):
    c = EV.canonical_event_type(dialect_types(spark, sf_dir))
    return c.select("event_id", "raw_event_type", "event_type", "is_core")


@register("assign_ttl", duck_sql(["fx_envelope"], "", f"""
select event_id, platform, event_type, {I.DUCK_TTL} as ttl from fx_envelope"""))
def q_assign_ttl(spark, sf_dir):
    e = fx.fx_envelope(spark, sf_dir)
    return EV.assign_ttl(e).select("event_id", "platform", "event_type", "ttl")


@register("typed_search", duck_sql(["fx_envelope"], "", """
select event_id, 'Query ' || cast(k % 13 as varchar) as search_query, cast(k % 7 as integer) as result_count
from fx_envelope where event_type = 'search'"""))
def q_typed_search(spark, sf_dir):
    return EV.typed_view(I.envelopes(spark, sf_dir), "search", keep=("event_id",)).select(
        "event_id", "search_query", "result_count")


@register("typed_purchase", duck_sql(["fx_envelope"], "", """
select event_id, amount, 'USD' as currency, case when k % 4 <> 0 then cast(k % 4 as integer) end as item_count
from fx_envelope where event_type = 'purchase'"""))
def q_typed_purchase(spark, sf_dir):
    return EV.typed_view(I.envelopes(spark, sf_dir), "purchase", keep=("event_id",)).select(
        "event_id", "amount", "currency", "item_count")


@register("typed_map_move", duck_sql(["fx_envelope"], "", """
select event_id, case k % 5 when 0 then 'move' when 1 then 'zoom' when 2 then 'filter' when 3 then 'center' else 'pan' end
  as interaction_type, cast(k % 18 as double) as zoom_level, lat as center_lat, lng as center_lng
from fx_envelope where event_type = 'map_move'"""))
def q_typed_map_move(spark, sf_dir):
    return EV.typed_view(I.envelopes(spark, sf_dir), "map_move", keep=("event_id",)).select(
        "event_id", "interaction_type", "zoom_level", "center_lat", "center_lng")


def app_opens(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    k = F.col("k")
    ctx = F.create_map(F.lit("language"), F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]),
                                                       (k % 4 + 1).cast("int")),
                       F.lit("timezone"), F.lit("UTC"), F.lit("viewport_width"), (F.lit(320) + k % 5 * 100).cast("string"))
    return env.withColumn("event_type", F.lit("app_open")).withColumn("context", ctx)


@register("page_load_dimension", duck_sql(["fx_envelope"], "", """
select uuid, max(ts_us) as last_open_us,
  arg_max(case k % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end, {'t': ts_us, 'e': event_id})
    as language, arg_max(cast(320 + k % 5 * 100 as varchar), {'t': ts_us, 'e': event_id}) as viewport_width
from fx_envelope group by uuid"""))
def q_page_load_dimension(spark, sf_dir):
    d = EV.page_load_dimension(app_opens(spark, sf_dir))
    return d.select("uuid", US("last_open").alias("last_open_us"), "language", "viewport_width")


@register("legacy_migration", duck_sql(["fx_envelope"], """
pr as (select uuid, max(ts_us) as ts_us, list(distinct category) as tags from fx_envelope group by uuid)""", """
select uuid, event_type, entity_id, ts_us from fx_envelope
union all select uuid, 'favorite', entity_id, ts_us from fx_envelope where event_type = 'share'
union all select uuid, 'tag_preference', t, ts_us from (select uuid, ts_us, unnest(tags) as t from pr) x
union all select uuid, 'user_migration', null, min(ts_us) from fx_envelope group by uuid
union all select uuid, 'user_preferences_migrated', null, ts_us from pr"""))
def q_legacy_migration(spark, sf_dir):
    env = I.envelopes(spark, sf_dir)
    legacy = env.select(F.col("uuid").alias("anon_user_id"), "event_type", "entity_id", "ts")
    saved = env.where(F.col("event_type") == "share").select(
        F.col("uuid").alias("anon_user_id"), F.col("entity_id").alias("saved_id"),
        F.concat(F.lit("Saved "), F.col("k").cast("string")).alias("saved_name"), "ts")
    prefs = env.groupBy(F.col("uuid").alias("anon_user_id")).agg(
        F.collect_set(F.col("context")["category"]).alias("preferred_tags"), F.max("ts").alias("ts"))
    m = EV.migrate_legacy(legacy, saved, prefs)
    return m.select("uuid", "event_type", "entity_id", US("ts").alias("ts_us"))


@register("event_store_scan", duck_sql(["fx_envelope"], "", """
select event_id, event_type, ts_us from fx_envelope where event_type in ('search', 'favorite')
  and cast(to_timestamp(ts_us / 1e6) as date) between date '2024-01-08' and date '2024-01-21'"""))
def q_event_store_scan(spark, sf_dir):
    """S4 write (date/type folders) then S3 scan pruned to two types and
    two weeks."""
    path = scratch_path(spark, "event-store")
    env = I.envelopes(spark, sf_dir).select("event_id", "event_type", "ts", "uuid", "platform")
    UP.write_events(env, path)
    got = UP.read_events_parquet(spark, path, "2024-01-08", "2024-01-21", ["search", "favorite"])
    return got.select("event_id", "event_type", US("ts").alias("ts_us"))


@register("typed_javascript_error", duck_sql(["fx_envelope"], "", """
select event_id, 'Error ' || cast(k % 5 as varchar) as error_message, 'app' || cast(k % 3 as varchar) || '.js'
  as error_filename, cast(k % 50 as integer) as error_line, cast(null as integer) as error_column, entity_id as page_url
from fx_envelope where event_type = 'javascript_error'"""))
def q_typed_javascript_error(spark, sf_dir):
    return EV.typed_view(I.envelopes(spark, sf_dir), "javascript_error", keep=("event_id",)).select(
        "event_id", "error_message", "error_filename", "error_line", "error_column", "page_url")


@register("typed_view_venue", duck_sql(["fx_envelope"], "", """
select event_id, cast(null as varchar) as venue_name, category, cast(null as double) as rating,
  cast(null as integer) as price_level from fx_envelope where event_type = 'view_venue'"""))
def q_typed_view_venue(spark, sf_dir):
    return EV.typed_view(I.envelopes(spark, sf_dir), "view_venue", keep=("event_id",)).select(
        "event_id", "venue_name", "category", "rating", "price_level")
