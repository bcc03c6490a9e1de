"""Aggregations over events.  All are hash aggregates with a
partial (map-side) step; distinct counts offer an ``approx`` variant
(HyperLogLog++) for cluster scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.jsmath import exact_sum, js_round
from footfall.functions.timeparts import hour_of_us, local_us, time_of_day
from footfall.operators.sessions import last_half_ewma
from footfall.sources import lookups as L


def _distinct(c: str, approx: bool) -> Column:
    return F.approx_count_distinct(c, 0.01) if approx else F.count_distinct(F.col(c))


def event_counts(df: DataFrame, dims: list[str] | None = None, approx: bool = False) -> DataFrame:
    """A1: events, users and sessions by event type × platform × day."""
    dims = dims or ["event_type", "platform", "event_date"]
    d = df.withColumn("event_date", F.to_date("ts")) if "event_date" in dims and "event_date" not in df.columns else df
    return d.groupBy(*dims).agg(F.count(F.lit(1)).alias("events"), _distinct("uuid", approx).alias("users"),
                                _distinct("session_id", approx).alias("sessions"))


def event_cube(df: DataFrame, approx: bool = False) -> DataFrame:
    """A2: A1 over type × platform with all subtotals (``cube``);
    ``grouping_id`` tells the subtotal level."""
    return df.cube("event_type", "platform").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("events"), _distinct("uuid", approx).alias("users"))


def impression_report(imps: DataFrame, key: str = "device_id") -> DataFrame:
    """A3: per device (or billboard) and content: impressions, Σ estimated
    viewers, Σ display time."""
    return imps.groupBy(key, "content_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("estimated_viewers").cast("bigint").alias("total_viewers"),
        F.sum("duration_ms").cast("bigint").alias("total_display_ms"))


def dwell_report(dwell: DataFrame, location: str = "location_id", tz: str | None = None) -> DataFrame:
    """A4: dwell seconds = JS-round(ms / 1000); average, maximum and peak
    viewers by location × time of day."""
    d = dwell.withColumn("dwell_seconds", js_round(F.col("dwell_time_ms") / F.lit(1000.0))) \
        .withColumn("time_of_day", time_of_day(hour_of_us(local_us(F.unix_micros("ts"), tz))))
    return d.groupBy(location, "time_of_day").agg(
        F.count(F.lit(1)).alias("observations"),
        (exact_sum("dwell_seconds").cast("double") / F.count(F.lit(1))).alias("avg_dwell_seconds"),
        F.max("dwell_seconds").alias("max_dwell_seconds"), F.max("estimated_viewers").alias("peak_viewers"))


def billboard_analytics(imps: DataFrame, as_of: Column, days: int = 30, key: str = "billboard_id",
                        ts: str = "ts") -> DataFrame:
    """A5 (fields documented, definitions ours): over the trailing ``days``
    before ``as_of``: total impressions, average engagement, peak crowd,
    total revenue and the top content by revenue (tie: larger id)."""
    start = F.timestamp_add("DAY", F.lit(-days), as_of)
    w = imps.where((F.col(ts) > start) & (F.col(ts) <= as_of))
    per_content = w.groupBy(key, "content_id").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("engagement_score").alias("s_eng"), F.max("crowd_size").alias("pk"),
        F.sum("revenue").alias("rev"))
    return per_content.groupBy(key).agg(
        F.sum("n").alias("total_impressions"),
        (F.sum("s_eng").cast("double") / F.sum("n")).alias("avg_engagement"),
        F.max("pk").alias("peak_crowd"), F.sum("rev").alias("total_revenue"),
        F.max_by("content_id", F.struct("rev", "content_id")).alias("top_content"))


def performance_summary(imps: DataFrame, key: str = "billboard_id") -> DataFrame:
    """Impressions, peak crowd, rotations (one per impression in the
    player), engagement as the half-step EWMA over impressions in order,
    revenue = impressions × 150."""
    base = imps.groupBy(key).agg(F.count(F.lit(1)).alias("impressions"), F.max("crowd_size").alias("peak_crowd"))
    ewma = last_half_ewma(imps, key, ["ts", "frame_id"], "engagement_score", "avg_engagement")
    return base.join(ewma, key).select(key, "impressions", "peak_crowd", F.col("impressions").alias("rotations"),
                                       "avg_engagement",
                                       (F.col("impressions") * L.REVENUE_PER_IMPRESSION).alias("revenue"))


def device_health(diag: DataFrame, key: str = "billboard_id") -> DataFrame:
    """From diagnostics samples: dropped-frame ratio, memory
    utilisation % = used / limit · 100 (average and peak), uptime, last
    error and last seen."""
    util = F.col("memory_used_mb") / F.col("memory_limit_mb") * 100
    g = diag.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        (F.count_if(F.col("dropped")) / F.count(F.lit(1))).alias("dropped_ratio"),
        (exact_sum(util).cast("double") / F.count(F.lit(1))).alias("avg_memory_pct"),
        F.max(util).alias("peak_memory_pct"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)).alias("uptime_s"),
        F.max_by(F.col("error"), F.when(F.col("error").isNotNull(), F.struct("ts", "error"))).alias("last_error"),
        F.max("ts").alias("last_seen"),
    )
    return g


def frame_counters(frames: DataFrame, key: str = "billboard_id") -> DataFrame:
    """Frames analysed, Σ people, peak cluster count, last update, and
    the processing-time "average" (half-step EWMA)."""
    g = frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames_analyzed"),
                                F.sum("total_people").cast("bigint").alias("total_people"),
                                F.max("cluster_count").alias("peak_crowd"), F.max("ts").alias("last_update"))
    e = last_half_ewma(frames, key, ["ts", "frame_id"], "processing_ms", "avg_processing_ms")
    return g.join(e, key)


def delivery_lag(df: DataFrame, late_after_s: int = 60, accuracy: int = 10000) -> DataFrame:
    """Ingest − event time per platform: p50 / p95 / p99 (approximate
    percentiles, mergeable sketches) and the share arriving later than
    ``late_after_s`` (the offline queue makes late events normal)."""
    lag = (F.unix_micros("ingest_ts") - F.unix_micros("ts"))
    return df.withColumn("_lag", lag).groupBy("platform").agg(
        F.count(F.lit(1)).alias("events"),
        F.percentile_approx("_lag", [0.5, 0.95, 0.99], accuracy).alias("_p"),
        (F.count_if(F.col("_lag") > late_after_s * 1_000_000) / F.count(F.lit(1))).alias("late_share"),
    ).select("platform", "events", F.col("_p")[0].alias("p50_us"), F.col("_p")[1].alias("p95_us"),
             F.col("_p")[2].alias("p99_us"), "late_share")


def search_terms(searches: DataFrame, k: int = 10, query: Column | None = None) -> DataFrame:
    """A10: the k most frequent normalised queries (ties: query text) and
    their zero-result rate.  Aggregate first, then a top-k (per-partition
    partial top-k, then merge)."""
    q = query if query is not None else F.lower(F.trim(F.col("context")["search_query"]))
    rc = F.col("context")["result_count"].try_cast("int")
    g = searches.where(F.col("event_type") == "search").withColumn("_q", q).where(F.col("_q") != "") \
        .groupBy("_q").agg(F.count(F.lit(1)).alias("searches"),
                           (F.count_if(rc == 0) / F.count(F.lit(1))).alias("zero_result_rate"))
    return g.orderBy(F.col("searches").desc(), F.col("_q")).limit(k).withColumnRenamed("_q", "query")


def search_ctr(df: DataFrame, session: str = "session_id") -> DataFrame:
    """A11 (pairing ours): a ``search_result_click`` belongs to the latest
    ``search`` of the same session before it (as-of); CTR per query =
    searches with at least one click / searches."""
    from footfall.operators.asof import asof_last
    rel = df.where(F.col("event_type").isin("search", "search_result_click"))
    q = F.lower(F.trim(F.col("context")["search_query"]))
    marked = rel.withColumn("_sid", F.when(F.col("event_type") == "search", F.col("event_id"))) \
        .withColumn("_q", F.when(F.col("event_type") == "search", q))
    got = asof_last(marked, session, "ts", ["ts", "event_id"], {"_last_search": F.col("_sid")})
    clicked = got.where((F.col("event_type") == "search_result_click") & F.col("_last_search").isNotNull()) \
        .select(F.col("_last_search").alias("event_id")).distinct().withColumn("_clicked", F.lit(1))
    s = marked.where(F.col("event_type") == "search").join(clicked, "event_id", "left")
    return s.groupBy(F.col("_q").alias("query")).agg(
        F.count(F.lit(1)).alias("searches"), F.count("_clicked").alias("clicked_searches")) \
        .withColumn("ctr", F.col("clicked_searches") / F.col("searches"))


VIEW_TYPES = ("view_venue", "view_event", "view_content")


def booking_conversion(df: DataFrame, approx: bool = False) -> DataFrame:
    """A12 (ours): per entity: distinct viewers, engaged users (favorite or
    share), bookers, and the view->engage / view->book rates."""
    u = F.col("uuid")
    cd = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else (lambda c: F.count_distinct(c))
    g = df.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        cd(F.when(F.col("event_type").isin(*VIEW_TYPES), u)).alias("viewers"),
        cd(F.when(F.col("event_type").isin("favorite", "share"), u)).alias("engaged"),
        cd(F.when(F.col("event_type") == "booking", u)).alias("bookers"))
    return g.withColumn("view_to_engage", F.try_divide(F.col("engaged").cast("double"), F.col("viewers"))) \
        .withColumn("view_to_book", F.try_divide(F.col("bookers").cast("double"), F.col("viewers")))
