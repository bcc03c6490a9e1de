"""Bring every client dialect to one envelope.

All functions are projections (no shuffle) except ``page_load_dimension``
(one aggregation by user) and ``migrate_legacy`` (unions)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.jsmath import truthy_str
from footfall.sources import lookups as L


def _map_lit(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def entity_id_expr(ctx: Column, envelope_entity: Column | None = None) -> Column:
    """First truthy of entity_id, venue_id, event_id (JS ``''`` is
    falsy), else NULL."""
    parts = [] if envelope_entity is None else [truthy_str(envelope_entity)]
    parts += [truthy_str(ctx[k]) for k in ("entity_id", "venue_id", "event_id")]
    return F.coalesce(*parts)


def _parse_ts(raw: Column) -> Column:
    """ISO text (JS, Android) or epoch seconds (iOS) -> TIMESTAMP."""
    is_num = raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    secs = raw.try_cast("decimal(24,6)")
    from_secs = F.timestamp_micros((secs * F.lit(1_000_000)).cast("bigint"))
    return F.when(is_num, from_secs).otherwise(F.try_to_timestamp(raw))


def _parse_tags(raw: Column, ctx: Column) -> Column:
    """JSON array (core, iOS) or comma string (Android); when the array is
    empty or missing, recover a comma string kept in ``context.tags``."""
    arr = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>")).when(
        truthy_str(raw).isNotNull(), F.split(raw, r"\s*,\s*")
    )
    from_ctx = F.when(
        truthy_str(ctx["tags"]).isNotNull() & ~F.trim(ctx["tags"]).startswith("["), F.split(ctx["tags"], r"\s*,\s*")
    ).when(F.trim(ctx["tags"]).startswith("["), F.from_json(ctx["tags"], "array<string>"))
    return F.coalesce(F.when(F.size(arr) > 0, arr), from_ctx, F.array().cast("array<string>"))


def normalize_envelope(raw: DataFrame) -> DataFrame:
    """Raw dialect rows (``schema.RAW_EVENT``) -> canonical envelope.

    * geo key ``geo`` or ``geo_context``; lat/lng or latitude/longitude;
      numbers or strings.
    * uuid falls back to the legacy ``anon_user_id``.
    * timestamps: ISO text or epoch seconds; Android sends local wall-clock
      time with a literal ``Z`` — kept as is and flagged ``ts_suspect``
      (see :func:`fix_device_clock`).
    * ``ingest_ts`` is the ``received_at`` that came with the batch (null
      where the rows have none); the clock of the run is never read, so
      running again gives equal rows.
    """
    received = F.col("received_at") if "received_at" in raw.columns else F.lit(None).cast("timestamp")
    ctx = F.coalesce(F.col("context"), F.create_map().cast("map<string,string>"))
    g, gc = F.col("geo"), F.col("geo_context")
    lat = F.coalesce(g["lat"], g["latitude"], gc["latitude"], gc["lat"]).try_cast("double")
    lng = F.coalesce(g["lng"], g["longitude"], gc["longitude"], gc["lng"]).try_cast("double")
    acc = F.coalesce(g["accuracy"], gc["accuracy"]).try_cast("double")
    geo_ts = _parse_ts(F.coalesce(g["timestamp"], gc["timestamp"]))
    geo = F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"),
                                                             acc.alias("accuracy"), geo_ts.alias("ts")))
    platform = F.lower(F.col("platform"))
    return raw.select(
        F.col("event_id"),
        F.col("event_type"),
        entity_id_expr(ctx, F.col("entity_id")).alias("entity_id"),
        _parse_ts(F.col("timestamp")).alias("ts"),
        received.alias("ingest_ts"),
        F.coalesce(truthy_str(F.col("uuid")), truthy_str(F.col("anon_user_id"))).alias("uuid"),
        F.col("session_id"),
        F.col("client_id"),
        platform.alias("platform"),
        F.col("device_id"),
        F.col("location_id"),
        ctx.alias("context"),
        geo.alias("geo"),
        _parse_tags(F.col("tags"), ctx).alias("tags"),
        F.col("ttl"),
        (platform == F.lit("android")).alias("ts_suspect"),
    )


def fix_device_clock(df: DataFrame, tz_col: str = "device_tz") -> DataFrame:
    """Android stamps local wall-clock time with a literal ``Z``.  When
    the device zone is known, reinterpret the stamp as local time; else keep
    the flag ``ts_suspect``."""
    known = F.col("ts_suspect") & F.col(tz_col).isNotNull()
    return df.withColumn("ts", F.when(known, F.to_utc_timestamp(F.col("ts"), F.col(tz_col))).otherwise(F.col("ts"))) \
        .withColumn("ts_suspect", F.col("ts_suspect") & F.col(tz_col).isNull())


def canonical_event_type(df: DataFrame, col: str = "event_type") -> DataFrame:
    """Dialect aliases -> one vocabulary; ``map_interaction`` takes its
    ``interaction_type``; unknown names pass through; ``is_core`` marks the
    SDK vocabularies."""
    aliases = _map_lit(L.EVENT_ALIASES)
    map_kind = F.lower(F.col("context")["interaction_type"]) if "context" in df.columns else F.lit(None)
    known_map = F.when(map_kind.isin("move", "zoom", "filter", "center"), F.concat(F.lit("map_"), map_kind)) \
        .otherwise(F.lit("map_move"))
    canon = F.when(F.col(col) == "map_interaction", known_map).otherwise(
        F.coalesce(F.element_at(aliases, F.col(col)), F.col(col))
    )
    vocab = sorted(set(L.CORE_EVENT_TYPES) | set(L.NODE_EVENT_TYPES))
    return df.withColumn("raw_event_type", F.col(col)).withColumn(col, canon) \
        .withColumn("is_core", F.col(col).isin(vocab))


def ttl_expr(platform: Column, event_type: Column) -> Column:
    """P5: TTL seconds keyed by (SDK family, event type) with the family's
    default; unknown platforms use the core rules."""
    fam = F.coalesce(F.element_at(_map_lit(L.PLATFORM_FAMILY), F.lower(platform)), F.lit("core"))
    flat = {f"{fam_}|{et}": days * L.DAY for fam_, m in L.TTL_DAYS.items() for et, days in m.items()}
    dflt = {fam_: d * L.DAY for fam_, d in L.TTL_DEFAULT_DAYS.items()}
    return F.coalesce(
        F.element_at(_map_lit(flat), F.concat(fam, F.lit("|"), event_type)),
        F.element_at(_map_lit(dflt), fam),
    ).cast("int")


def assign_ttl(df: DataFrame) -> DataFrame:
    """P5 on a DataFrame with ``platform`` and ``event_type``."""
    return df.withColumn("ttl", ttl_expr(F.col("platform"), F.col("event_type")))


# ---- P9: typed views from one spec table ---------------------------------
# event family -> (context key, Spark type).  One generic projection serves
# every family; new families are new rows, not new functions.  "a|b" reads the
# key a, or where that is missing b, into the column a.
# The keys are those that the clients send.
VIDEO_KEYS = [("video_src", "string"), ("video_duration", "double"), ("video_current_time", "double"),
              ("action", "string"), ("video_width", "int"), ("video_height", "int"), ("video_id", "string"),
              ("page_url", "string")]
CONTENT_KEYS = [("content_id", "string"), ("content_name", "string"), ("content_type", "string")]
TYPED_SPEC: dict[str, list[tuple[str, str]]] = {
    "app_open": [("url", "string"), ("title", "string"), ("path", "string"), ("referrer", "string"),
                 ("user_agent", "string"), ("viewport_width", "int"), ("viewport_height", "int"),
                 ("screen_width", "int"), ("screen_height", "int"), ("color_depth", "int"), ("pixel_ratio", "double"),
                 ("timezone", "string"), ("language", "string"), ("connection_type", "string"), ("platform", "string"),
                 ("cookie_enabled", "boolean"), ("java_enabled", "boolean")],
    "view_content": [("url", "string"), ("title", "string"), ("path", "string"), ("referrer", "string"),
                     ("search", "string"), ("hash", "string")],
    "scroll_depth": [("scroll_percentage", "int"), ("page_height", "double"), ("viewport_height", "double"),
                     ("scroll_position", "double"), ("time_to_depth", "bigint")],
    "click": [("element_tag", "string"), ("element_id", "string"), ("element_class", "string"),
              ("element_text", "string"), ("element_href", "string"), ("element_type", "string"),
              ("x_position", "double"), ("y_position", "double"), ("page_x", "double"), ("page_y", "double")],
    "link_click": [("link_url", "string"), ("link_domain", "string"), ("is_external", "boolean"),
                   ("link_target", "string")],
    "form_interaction": [("form_id", "string"), ("form_action", "string"), ("form_method", "string"),
                         ("field_count", "int"), ("action_type", "string")],
    "video_interaction": [*VIDEO_KEYS],
    "video_milestone": [*VIDEO_KEYS, ("milestone_percentage", "int")],
    "download": [("download_url", "string"), ("file_name", "string"), ("file_extension", "string"),
                 ("link_text", "string"), ("page_url", "string")],
    "search": [("search_query", "string"), ("result_count", "int"), ("has_location_filter", "boolean"),
               ("has_date_filter", "boolean"), ("has_category_filter", "boolean"), ("search_form_id", "string"),
               ("page_url", "string")],
    "search_input": [("search_partial", "string"), ("input_length", "int"), ("page_url", "string")],
    "add_to_cart": [("product_id", "string"), ("button_text", "string")],
    "checkout_started": [("button_text", "string")],
    "javascript_error": [("error_message", "string"), ("error_filename", "string"), ("error_line", "int"),
                         ("error_column", "int"), ("page_url", "string")],
    "promise_rejection": [("error_message", "string"), ("page_url", "string")],
    "page_performance": [("dns_lookup", "double"), ("tcp_connection", "double"), ("server_response", "double"),
                         ("dom_processing", "double"), ("page_load", "double"), ("navigation_type", "string")],
    "content_view": [("content_id", "string"), ("content_type", "string"), ("content_name", "string")],
    "screen_view": [("screen_name", "string")],
    "button_tap": [("button_title", "string"), ("button_text", "string")],
    "view_venue": [("venue_id", "string"), ("venue_name", "string"), ("category", "string"),
                   ("rating", "double"), ("price_level", "int")],
    "view_event": [("event_id", "string"), ("event_name", "string"), ("event_date", "string"),
                   ("venue_id", "string"), ("category", "string"), ("price", "double")],
    "map_move": [("interaction_type", "string"), ("zoom_level", "double"), ("center_lat", "double"),
                 ("center_lng", "double")],
    "tag_interaction": [("tag_id", "string"), ("tag_name", "string"), ("tag_category", "string"),
                        ("interaction_type", "string")],
    "favorite": [("entity_type", "string"), ("entity_name", "string")],
    "share": [("entity_type", "string"), ("share_platform", "string")],
    "purchase": [("transaction_id", "string"), ("amount", "double"), ("total_amount", "double"),
                 ("currency", "string"), ("item_count", "int")],
    # a billboard's impression is canonically an impression; it names its duration duration_ms
    "impression": [*CONTENT_KEYS, ("content_duration|duration_ms", "bigint"), ("estimated_viewers", "int"),
                   ("display_time", "string")],
    "dwell_time": [("dwell_time_ms", "bigint"), ("dwell_time_seconds", "bigint"), ("estimated_viewers", "int"),
                   ("location_id", "string")],
    "content_start": [*CONTENT_KEYS, ("content_duration", "bigint"), ("start_time", "string")],
    "content_end": [*CONTENT_KEYS, ("planned_duration", "bigint"), ("actual_duration", "bigint"),
                    ("end_time", "string"), ("completion_rate", "double")],
    "interaction": [("interaction_type", "string"), ("interaction_time", "string"), ("location_id", "string"),
                    ("content_id", "string")],
    "system_event": [("system_event_type", "string"), ("device_id", "string"), ("location_id", "string")],
    "billboard_lidar_init": [("billboard_id", "string"), ("sensor_type", "string"), ("compute_unit", "string"),
                             ("privacy_mode", "string"), ("location", "string")],
    "billboard_context_update": [("billboard_id", "string"), ("location", "string"), ("cluster_count", "int"),
                                 ("avg_density", "double"), ("flow_direction", "string"), ("dwell_time_avg", "double"),
                                 ("engagement_score", "double"), ("environmental", "string"),
                                 ("demographic_inference", "string")],
    "billboard_impression": [("billboard_id", "string"), ("content_id", "string"), ("duration_ms", "bigint"),
                             ("estimated_viewers", "int"), ("location", "string")],
    "billboard_dwell_analysis": [("billboard_id", "string"), ("avg_dwell_time_ms", "double"),
                                 ("peak_concurrency", "int"), ("time_of_day", "string"), ("location", "string")],
    "billboard_content_rotation": [("billboard_id", "string"), ("previous_content", "string"),
                                   ("new_content", "string"), ("trigger_reason", "string"), ("location", "string")],
    "billboard_anomaly_detected": [("billboard_id", "string"), ("anomaly_type", "string"), ("severity", "string"),
                                   ("details", "string"), ("location", "string")],
    "billboard_privacy_mode_changed": [("billboard_id", "string"), ("new_mode", "string")],
    "billboard_demographic_settings_changed": [("billboard_id", "string"), ("demographics_enabled", "boolean")],
    # nested objects stay JSON text
    "billboard_system_diagnostics": [("billboard_id", "string"), ("lidar_sensor", "string"),
                                     ("vision_pipeline", "string"), ("context_analyzer", "string"),
                                     ("network_connectivity", "string"), ("storage_usage", "string"),
                                     ("processing_performance", "string")],
    "billboard_lidar_shutdown": [("billboard_id", "string"), ("uptime_seconds", "double"),
                                 ("total_frames_processed", "bigint"), ("location", "string")],
}


def typed_view(df: DataFrame, kind: str, keep: tuple[str, ...] = ("event_id", "uuid", "session_id", "ts",
                                                                   "platform")) -> DataFrame:
    """Typed columns out of ``context`` for one event family."""
    spec = TYPED_SPEC[kind]
    ctx = F.col("context")
    cols = [F.col(c) for c in keep if c in df.columns]
    for names, t in spec:
        k, *others = names.split("|")
        value = F.coalesce(*[ctx[x].try_cast(t) for x in (k, *others)])
        cols.append(value.alias(f"ctx_{k}" if k in keep else k))
    return df.where(F.col("event_type") == kind).select(*cols)


def page_load_dimension(df: DataFrame) -> DataFrame:
    """P10: latest device/browser profile per user from ``app_open``."""
    keys = ("language", "timezone", "viewport_width", "viewport_height", "screen_width", "screen_height",
            "pixel_ratio", "connection_type", "user_agent")
    opens = df.where(F.col("event_type") == "app_open")
    prof = F.struct(*[F.col("context")[k].alias(k) for k in keys])
    return opens.groupBy("uuid").agg(F.max_by(prof, F.struct("ts", "event_id")).alias("p"),
                                     F.max("ts").alias("last_open")).select("uuid", "last_open", "p.*")


def pseudonymise(df: DataFrame, col: str, salt: str, prefix: str = "anon-", out: str | None = None) -> DataFrame:
    """Stable keyed hash instead of a random per-device uuid."""
    return df.withColumn(out or col, F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(salt), F.col(col).cast("string")),
                                                                    256)))


def migrate_legacy(events: DataFrame, saved: DataFrame, prefs: DataFrame) -> DataFrame:
    """Legacy envelope + saved events + tag preferences -> envelopes.

    * ``anon_user_id`` -> ``uuid``
    * each saved event -> ``favorite`` (entity_type ``event``)
    * each preferred tag (string or ``{id,name}`` JSON) -> ``tag_preference``
      with source ``migration``
    * one ``user_migration`` per old id, one ``user_preferences_migrated``
      per profile.

    ``saved``: (anon_user_id, saved_id, saved_name, ts); ``prefs``:
    (anon_user_id, preferred_tags array<string>, ts)."""
    ev = events.withColumnRenamed("anon_user_id", "uuid")
    fav = saved.select(
        F.col("anon_user_id").alias("uuid"), F.lit("favorite").alias("event_type"),
        F.col("saved_id").alias("entity_id"), F.col("ts"),
        F.create_map(F.lit("entity_type"), F.lit("event"), F.lit("entity_name"), F.col("saved_name"),
                     F.lit("source"), F.lit("migration")).alias("context"),
    )
    tag = prefs.select("anon_user_id", "ts", F.explode("preferred_tags").alias("t")).select(
        F.col("anon_user_id").alias("uuid"), F.lit("tag_preference").alias("event_type"),
        F.coalesce(F.get_json_object("t", "$.id"), F.col("t")).alias("entity_id"), F.col("ts"),
        F.create_map(F.lit("tag_id"), F.coalesce(F.get_json_object("t", "$.id"), F.col("t")),
                     F.lit("tag_name"), F.coalesce(F.get_json_object("t", "$.name"), F.col("t")),
                     F.lit("source"), F.lit("migration")).alias("context"),
    )
    users = events.groupBy("anon_user_id").agg(F.min("ts").alias("ts")).select(
        F.col("anon_user_id").alias("uuid"), F.lit("user_migration").alias("event_type"),
        F.lit(None).cast("string").alias("entity_id"), "ts",
        F.create_map(F.lit("source"), F.lit("migration")).alias("context"),
    )
    prof = prefs.select(
        F.col("anon_user_id").alias("uuid"), F.lit("user_preferences_migrated").alias("event_type"),
        F.lit(None).cast("string").alias("entity_id"), "ts",
        F.create_map(F.lit("tag_count"), F.size("preferred_tags").cast("string")).alias("context"),
    )
    return ev.unionByName(fav, allowMissingColumns=True).unionByName(tag, allowMissingColumns=True) \
        .unionByName(users, allowMissingColumns=True).unionByName(prof, allowMissingColumns=True)
