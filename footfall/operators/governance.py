"""Governance: TTL expiry (P6), frame retention (P7), privacy projection
(P8), PII redaction (P11), consent (J1), opt-out purge (J2), erasure (J3)
and exactly-once dedup (J4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.asof import asof_last
from footfall.operators.envelope import TYPED_SPEC
from footfall.sources import lookups as L

EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
# Form context keys that describe structure (values are never sent)
FORM_KEYS = ["form_id", "form_action", "form_method", "field_count", "form_name", "action_type", "page_url",
             "field_types"]
# Keys of free text, of addresses, of search text, and the parts of an address that carry input
TEXT_KEYS = ["element_text", "text", "button_text", "button_title", "label", "link_text"]
URL_KEYS = ["url", "referrer", "page_url", "link_url", "element_href", "download_url", "video_src", "form_action"]
QUERY_KEYS = ["search_query", "search_partial"]
DROPPED_KEYS = ["search", "hash"]
#: Keys that any family may send.
COMMON_KEYS = [*TEXT_KEYS, "category", "entity_id", "venue_id", "utm_source", "field_count", *QUERY_KEYS]


def filter_live(df: DataFrame, as_of: Column, ts_col: str = "ts", ttl_col: str = "ttl") -> DataFrame:
    """Keep rows whose TTL has not run out: ``ts + ttl > as_of``."""
    return df.where(F.timestamp_add("SECOND", F.col(ttl_col), F.col(ts_col)) > as_of)


# ---------------------------------------------------------------- consent
def consent_state(events: DataFrame, consent_log: DataFrame, key: str = "uuid", ts: str = "ts",
                  id_col: str = "event_id") -> DataFrame:
    """The latest consent change at or before each event (``consent``
    column, NULL = never changed).  A change at the same instant as an event
    sorts first (conservative)."""
    ev = events.withColumn("_kind", F.lit(1)).withColumn("_change", F.lit(None).cast("string"))
    ch = consent_log.select(
        F.col(key), F.col(ts), F.lit(0).alias("_kind"), F.col("change").alias("_change"),
        F.lit(None).cast("string").alias(id_col),
    )
    u = ev.unionByName(ch, allowMissingColumns=True)
    got = asof_last(u, key, ts, [ts, "_kind", id_col], {"consent": F.col("_change")})
    return got.where(F.col("_kind") == 1).drop("_kind", "_change", "consent_ts")


def apply_consent(events: DataFrame, consent_log: DataFrame, strict_restart: bool = False,
                  session_col: str = "session_id") -> DataFrame:
    """Keep an event iff the latest consent change at or before it is
    not ``opt_out`` (default: opted in).

    ``strict_restart``: an app that starts opted out never initialises, so
    an opt-in only takes effect from the next session — an event is also
    dropped when its session began while the user was opted out."""
    st = consent_state(events, consent_log)
    kept = st.where(F.coalesce(F.col("consent"), F.lit("opt_in")) != F.lit("opt_out"))
    if not strict_restart:
        return kept.drop("consent")
    starts = events.groupBy("uuid", session_col).agg(F.min("ts").alias("ts")) \
        .withColumn("event_id", F.concat(F.lit("~session~"), F.col(session_col)))
    start_state = consent_state(starts, consent_log).where(F.col("consent") == "opt_out") \
        .select("uuid", session_col)
    return kept.join(start_state, ["uuid", session_col], "left_anti").drop("consent")


def purge_on_optout(events: DataFrame, consent_log: DataFrame) -> DataFrame:
    """An opt-out also deletes events still queued on the device:
    ``ts <= opt_out_ts < ingest_ts``.  Delivered events stay.

    Equi-join on the user with a range condition (left anti); the opt-out
    side is a small change log, and AQE can split a skewed user."""
    outs = consent_log.where(F.col("change") == "opt_out").select(
        F.col("uuid").alias("_u"), F.col("ts").alias("_out_ts"))
    cond = (F.col("uuid") == F.col("_u")) & (F.col("ts") <= F.col("_out_ts")) & (F.col("_out_ts") < F.col("ingest_ts"))
    return events.join(outs, cond, "left_anti")


def erase_users(df: DataFrame, ids: DataFrame, key: str = "uuid") -> DataFrame:
    """Full-history erasure.  Left anti join; the id list is broadcast
    by AQE only when its runtime size is under the broadcast threshold."""
    return df.join(ids.select(F.col(key)).distinct(), key, "left_anti")


def dedup(df: DataFrame, key: str = "event_id", ingest_col: str = "ingest_ts") -> DataFrame:
    """Exactly one row per event id, earliest ingest wins.

    ``row_number() = 1`` is planned with a window-group limit: each task keeps
    one row per id before the shuffle, so a retry storm on one id ships one row
    per task and every row is carried once.  Ties go by the other columns, maps by a hash of their text.
    """
    others = [c for c in df.columns if c not in (key, ingest_col)]
    cols = [F.col(c) for c in others if _orderable(df, c)] + [F.xxhash64(F.to_json(c)) for c in others if not _orderable(df, c)]
    w = Window.partitionBy(key).orderBy(ingest_col, *cols)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").select(key, *[c for c in df.columns if c != key])


def _orderable(df: DataFrame, c: str) -> bool:
    from pyspark.sql.types import MapType
    return not isinstance(df.schema[c].dataType, MapType)


# ---------------------------------------------------------------- frames
def retention(frames: DataFrame, mode_log: DataFrame, as_of: Column, key: str = "billboard_id",
              default_mode: str = "strict") -> DataFrame:
    """Frames still held at ``as_of``.

    A frame is stored with ``expires = ts + retention(mode at ts)``
    (strict 300 s, balanced 1800 s, minimal 3600 s) and is gone when
    ``expires <= as_of``.  A switch to ``strict`` at time t clears every
    frame stored before t.  ``mode_log``: (key, ts, mode)."""
    modes = mode_log.select(key, "ts", F.col("mode").alias("_mode"), F.lit(0).alias("_kind"))
    fr = frames.withColumn("_kind", F.lit(1)).withColumn("_mode", F.lit(None).cast("string"))
    u = fr.unionByName(modes, allowMissingColumns=True)
    got = asof_last(u, key, "ts", ["ts", "_kind", "frame_id"], {"mode": F.col("_mode")})
    keep_s = F.element_at(F.create_map(*[x for k, v in L.PRIVACY_RETENTION_S.items()
                                         for x in (F.lit(k), F.lit(v))]),
                          F.coalesce(F.col("mode"), F.lit(default_mode)))
    held = got.where(F.col("_kind") == 1).withColumn("mode", F.coalesce(F.col("mode"), F.lit(default_mode))) \
        .withColumn("expires_at", F.timestamp_add("SECOND", keep_s, F.col("ts"))) \
        .where(F.col("expires_at") > as_of)
    clears = mode_log.where((F.col("mode") == "strict") & (F.col("ts") <= as_of)) \
        .groupBy(key).agg(F.max("ts").alias("_clear_ts"))
    return held.join(clears, key, "left").where(F.col("_clear_ts").isNull() | (F.col("ts") >= F.col("_clear_ts"))) \
        .drop("_kind", "_mode", "mode_ts", "_clear_ts")


def privacy_project(frames: DataFrame, mode: Column, demographics_on: Column | bool = False,
                    demographic_cols: tuple[str, ...] = ("age_distribution", "gender_distribution"),
                    pose_cols: tuple[str, ...] = ("engagement", "attention")) -> DataFrame:
    """Demographic columns only when enabled and mode != strict; pose
    metrics only in ``minimal`` (elsewhere the pose model is off, so the
    frame metric falls back to 0); face detection is never on."""
    demo_ok = (F.lit(demographics_on) if isinstance(demographics_on, bool) else demographics_on) & (mode != "strict")
    out = frames
    for c in demographic_cols:
        if c in frames.columns:
            out = out.withColumn(c, F.when(demo_ok, F.col(c)))
    for c in pose_cols:
        if c in frames.columns:
            out = out.withColumn(c, F.when(mode == "minimal", F.col(c)).otherwise(F.lit(0.0)))
    return out.withColumn("face_detection", F.lit(False))


# ---------------------------------------------------------------- PII
def redact_pii(df: DataFrame, salt: str = "", max_text: int = 100) -> DataFrame:
    """Only keys that the event's family sends are kept (its typed view's
    keys and ``COMMON_KEYS``), each by its kind; an unknown key, or any key of
    an unknown family, does not pass.

    * form events keep structure keys only (never field values);
    * numbers and flags must be numbers and flags;
    * search text is replaced by a keyed hash;
    * addresses lose query and fragment, a page's own query and fragment
      (``search``, ``hash``) are dropped;
    * every other text is cut to ``max_text`` characters with e-mail addresses
      and phone numbers masked."""
    def among(k, names):
        return F.array_contains(F.array(*[F.lit(x) for x in sorted(names)]), k)

    ctx = F.col("context")
    is_form = F.col("event_type").isin("form_interaction", "form_submit")
    form_only = F.map_filter(ctx, lambda k, v: among(k, FORM_KEYS))
    own = {f: [n for names, _t in spec for n in names.split("|")] for f, spec in TYPED_SPEC.items()}
    family = F.create_map(*[x for f, names in own.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in names]))])
    of_family = F.coalesce(F.get(F.array(family), F.lit(0))[F.col("event_type")], F.array().cast("array<string>"))
    kinds: dict[str, set[str]] = {}
    for spec in TYPED_SPEC.values():
        for names, kind in spec:
            for n in names.split("|"):
                kinds.setdefault(n, set()).add(kind)
    flags = [n for n, k in kinds.items() if k == {"boolean"}]
    numbers = [n for n, k in kinds.items() if k <= {"int", "bigint", "double"}]

    def masked(v):
        return F.substring(F.regexp_replace(F.regexp_replace(v, EMAIL_RE, "[email]"), PHONE_RE, "[phone]"), 1, max_text)

    known = F.map_filter(ctx, lambda k, v: (among(k, COMMON_KEYS) | F.array_contains(of_family, k)) & ~among(k, DROPPED_KEYS))
    clean = F.transform_values(known, lambda k, v: F.when(among(k, numbers), F.when(v.try_cast("double").isNotNull(), v))
                               .when(among(k, flags), F.when(v.try_cast("boolean").isNotNull(), v))
                               .when(among(k, QUERY_KEYS), F.concat(F.lit("q:"), F.substring(
                                   F.sha2(F.concat(F.lit(salt), F.lower(F.trim(v))), 256), 1, 16)))
                               .when(among(k, URL_KEYS), masked(F.regexp_extract(v, "^[^?#]*", 0)))
                               .otherwise(masked(v)))
    return df.withColumn("context", F.when(is_form, form_only).otherwise(clean))
