"""Joins that attach context to events: geo fixes (J5), static device
locations (J6), location thinning (J7), playing content (J8), weather
(J9)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.asof import asof_last
from footfall.sources import lookups as L

EARTH_R_M = 6371000.0


def attach_geo(events: DataFrame, fixes: DataFrame, max_age_s: int | None = 300) -> DataFrame:
    """Explicit ``geo`` wins; else the latest fix of the same user at or
    before the event and not older than ``max_age_s`` (300 s is the web
    ``maximumAge``; ``None`` = no cap, as on iOS).

    ``fixes``: (uuid, ts, lat, lng, accuracy).  Adds ``geo_source``."""
    ev = events.withColumn("_kind", F.lit(1)).withColumn("_fix", F.lit(None).cast(
        "struct<lat:double,lng:double,accuracy:double>"))
    fx = fixes.select("uuid", "ts", F.lit(0).alias("_kind"),
                      F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"),
                               F.col("accuracy").cast("double").alias("accuracy")).alias("_fix"),
                      F.lit(None).cast("string").alias("event_id"))
    u = ev.unionByName(fx, allowMissingColumns=True)
    got = asof_last(u, "uuid", "ts", ["ts", "_kind", "event_id"], {"fix": F.col("_fix")},
                    max_age_us=None if max_age_s is None else max_age_s * 1_000_000)
    got = got.where(F.col("_kind") == 1)
    has_geo = F.col("geo").isNotNull() & F.col("geo.lat").isNotNull()
    filled = F.when(has_geo, F.col("geo")).when(
        F.col("fix").isNotNull(),
        F.struct(F.col("fix.lat").alias("lat"), F.col("fix.lng").alias("lng"), F.col("fix.accuracy").alias("accuracy"),
                 F.col("fix_ts").alias("ts")))
    src = F.when(has_geo, F.lit("explicit")).when(F.col("fix").isNotNull(), F.lit("fix"))
    return got.withColumn("geo_source", src).withColumn("geo", filled).drop("_kind", "_fix", "fix", "fix_ts")


def attach_static_location(events: DataFrame, devices: DataFrame, key: str = "device_id") -> DataFrame:
    """Node / billboard events take the configured device location with
    accuracy 0.  ``devices``: (device_id, lat, lng).  Equi left join; AQE
    broadcasts the device table when its runtime size is small."""
    d = devices.select(F.col(key), F.struct(F.col("lat").cast("double").alias("lat"),
                                            F.col("lng").cast("double").alias("lng"),
                                            F.lit(0.0).alias("accuracy")).alias("_loc"))
    return events.join(d, key, "left").withColumn(
        "geo", F.struct(F.col("_loc.lat").alias("lat"), F.col("_loc.lng").alias("lng"),
                        F.col("_loc.accuracy").alias("accuracy"), F.col("ts").alias("ts"))
    ).withColumn("geo", F.when(F.col("_loc").isNotNull(), F.col("geo"))).drop("_loc")


def haversine_m(lat1, lng1, lat2, lng2):
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lng2) - F.radians(lng1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_R_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def thin_locations(fixes: DataFrame, min_distance_m: float = 100.0, min_interval_s: int = 0,
                   group: str = "session_id") -> DataFrame:
    """The device only reports a fix after moving ``min_distance_m``
    from the last reported one (and, Android, ``min_interval_s`` after
    it).  The filter state lives with the watch, which starts with the
    session, so it runs per session: the first fix of a session is
    always reported.  Rows without a position or time are no fixes.

    Whether a fix is kept depends on the last *kept* one, so a session is
    read in order: rows are dealt by user and session, sorted inside the
    partitions (the sort spills), and one pass per partition carries the
    current session's last kept fix from batch to batch.  Nothing is
    collected; a task holds one Arrow batch and one fix."""
    real = F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("ts").isNotNull()
    keyed = fixes.where(real).withColumn("_s", F.struct("uuid", F.col(group).alias("g"))) \
        .withColumn("_at", F.struct(F.unix_micros("ts").alias("t"), F.col("lat").cast("double").alias("y"), F.col("lng").cast("double").alias("x")))
    dealt = keyed.repartition("uuid", group).sortWithinPartitions("uuid", group, "ts", "event_id")
    # haversine >= distance, with the arc sine taken on the limit's side once
    reach = math.sin(min(min_distance_m / (2 * EARTH_R_M), math.pi / 2)) ** 2
    wait_us = min_interval_s * 1_000_000
    schema = keyed.schema

    def scan(batches):
        import pyarrow as pa

        session, last = None, None
        for batch in batches:
            at = batch.column(batch.num_columns - 1)
            t, lat, lng = (at.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            lat, lng = np.radians(lat), np.radians(lng)
            cos, kept = np.cos(lat), []
            whose = batch.column(batch.num_columns - 2)
            for i, (own, ti, yi, xi, ci) in enumerate(zip(whose.to_pylist(), t.tolist(), lat.tolist(), lng.tolist(), cos.tolist())):
                if own != session or last is None:
                    session, take = own, True
                else:
                    t0, y0, x0, c0 = last
                    arc = math.sin((yi - y0) / 2) ** 2 + c0 * ci * math.sin((xi - x0) / 2) ** 2
                    take = arc >= reach and ti - t0 >= wait_us
                if take:
                    last = (ti, yi, xi, ci)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return dealt.mapInArrow(scan, schema).drop("_s", "_at")


def content_at_interaction(df: DataFrame, device: str = "device_id") -> DataFrame:
    """Each interaction gets the content playing on its device: the
    last content_start / content_end before it (NULL after an end).  The
    interaction's own ``content_id`` detail overrides, as later keys do."""
    marker = F.when(F.col("event_type") == "content_start", F.col("content_id")) \
        .when(F.col("event_type") == "content_end", F.lit(""))
    got = asof_last(df, device, "ts", ["ts", "event_id"], {"_playing": marker})
    inter = got.where(F.col("event_type") == "interaction")
    own = F.col("detail_content_id") if "detail_content_id" in df.columns else F.lit(None).cast("string")
    return inter.withColumn("current_content", F.coalesce(own, F.when(F.col("_playing") != "", F.col("_playing")))) \
        .drop("_playing", "_playing_ts")


def attach_weather(df: DataFrame, weather: DataFrame, key: str = "location_id") -> DataFrame:
    """Latest weather observation of the location at or before each row
    (as-of), then the fixed factor lookup (crowd/dwell multipliers,
    engagement bonus).  ``weather``: (location key, ts, condition)."""
    rows = df.withColumn("_kind", F.lit(1)).withColumn("_cond", F.lit(None).cast("string"))
    obs = weather.select(key, "ts", F.lit(0).alias("_kind"), F.col("condition").alias("_cond"))
    u = rows.unionByName(obs, allowMissingColumns=True)
    got = asof_last(u, key, "ts", ["ts", "_kind", "frame_id" if "frame_id" in df.columns else "ts"],
                    {"weather": F.col("_cond")})
    got = got.where(F.col("_kind") == 1).drop("_kind", "_cond", "weather_ts")
    fac = {c: v for c, v in L.WEATHER_FACTORS.items()}
    m = lambda i: F.create_map(*[x for c, v in fac.items() for x in (F.lit(c), F.lit(v[i]))])
    w = F.coalesce(F.col("weather"), F.lit("cloudy"))
    return got.withColumn("crowd_multiplier", F.element_at(m(0), w)) \
        .withColumn("dwell_multiplier", F.element_at(m(1), w)) \
        .withColumn("engagement_bonus", F.element_at(m(2), w))
