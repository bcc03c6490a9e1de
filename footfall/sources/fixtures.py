"""Deterministic views that give the driver tables the shapes of the
domain (event envelopes, consent log, frames, detections, points, poses,
movements, playback, scroll, buttons, links).

Each view exists twice: as a Spark DataFrame (used by the library queries)
and as DuckDB SQL text (used by the independent oracle).  The two are
written separately on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.timeparts import micros_of
from footfall.sources.tables import read_table

EPOCH_2024_US = 1704067200000000  # 2024-01-01T00:00:00Z


def _s(c) -> F.Column:
    return F.col(c).cast("string")


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def fx_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "user_id",
        "value",
        F.col("event_type").alias("src"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        micros_of(ev, "ts").alias("ts_us"),
    )


def fx_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx_base(spark, sf_dir)
    k = F.col("k")
    etype = (
        F.when(F.col("src") == "view", "view_venue")
        .when(F.col("src") == "error", "javascript_error")
        .when(F.col("src") == "purchase", "purchase")
        .when(F.col("src") == "signup", F.when(k % 2 == 0, "favorite").otherwise("share"))
        .otherwise(
            F.when(k % 4 == 0, "add_to_cart")
            .when(k % 4 == 1, "tag_interaction")
            .when(k % 4 == 2, "search")
            .otherwise("map_move")
        )
    )
    uid = F.col("user_id")
    platform = (
        F.when(uid % 5 == 0, "web").when(uid % 5 == 1, "react-native").when(uid % 5 == 2, "ios")
        .when(uid % 5 == 3, "android").otherwise("node")
    )
    cats = ["music", "food", "art", "sports", "tech", "travel"]
    category = F.element_at(F.array(*[F.lit(c) for c in cats]), (k % 6 + 1).cast("int"))
    utm = F.when(k % 3 == 0, "instagram").when(k % 3 == 1, "email")
    return b.select(
        F.concat(F.lit("evt_"), _s("event_id")).alias("event_id"),
        etype.alias("event_type"),
        F.concat(F.lit("venue_"), _s("k")).alias("entity_id"),
        F.col("ts_us"),
        (F.col("ts_us") + F.when(k % 10 == 0, F.lit(7200000000)).otherwise(F.lit(1000000))).alias("ingest_us"),
        F.concat(F.lit("anon-"), _s("user_id")).alias("uuid"),
        platform.alias("platform"),
        category.alias("category"),
        utm.alias("utm_source"),
        (F.lit(40.0) + (k % 10) / F.lit(10.0)).alias("lat"),
        (F.lit(-74.0) + (uid % 10) / F.lit(10.0)).alias("lng"),
        F.col("value").alias("amount"),
        k,
    )


def fx_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx_base(spark, sf_dir)
    return b.where((F.col("src") == "signup") & (F.col("k") % 3 < 2)).select(
        F.concat(F.lit("anon-"), _s("user_id")).alias("uuid"),
        "ts_us",
        F.when(F.col("k") % 3 == 0, "opt_out").otherwise("opt_in").alias("change"),
    )


DIRECTIONS8 = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]


def fx_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx_base(spark, sf_dir)
    k = F.col("k")
    flow = F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS8]), (k % 8 + 1).cast("int"))
    return b.select(
        F.concat(F.lit("bb_"), (F.col("user_id") % 5).cast("string")).alias("billboard_id"),
        F.col("event_id").alias("frame_id"),
        (F.lit(EPOCH_2024_US) + F.floor((F.col("ts_us") - F.lit(EPOCH_2024_US)) / F.lit(600.0)).cast("bigint")).alias("ts_us"),
        F.col("ts_us").alias("ts_us_raw"),
        (k % 20).alias("cluster_count"),
        (k % 30).alias("total_people"),
        (F.col("value") / F.lit(100.0)).alias("avg_density"),
        flow.alias("flow_direction"),
        F.col("value").alias("dwell_avg"),
        ((k % 10) / F.lit(10.0)).alias("engagement"),
        ((k % 7) / F.lit(7.0)).alias("attention"),
        (k % 50 + 10).alias("processing_ms"),
    )


def fx_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("o1"),
        F.col("l_partkey").alias("o2"),
        F.col("l_suppkey").alias("o3"),
        ((F.col("l_partkey") % 41) / F.lit(10.0) - F.lit(2.0)).alias("x"),
        ((F.col("l_suppkey") % 41) / F.lit(10.0) - F.lit(2.0)).alias("y"),
        (F.col("l_quantity") / F.lit(25.0)).alias("z"),
        (F.lit(0.6) + F.col("l_discount") * F.lit(4.0)).alias("confidence"),
    )


def fx_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").alias("o1"),
        F.col("l_partkey").alias("o2"),
        F.col("l_suppkey").alias("o3"),
        F.col("l_quantity").alias("x"),
        (F.col("l_suppkey") % 21 - 10).cast("double").alias("y"),
        ((F.col("l_partkey") % 26) / F.lit(10.0)).alias("z"),
    )


def fx_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame_id"),
        (F.col("l_discount") * F.lit(10.0)).alias("engagement_score"),
        F.when(F.col("l_returnflag") == "R", "billboard").otherwise("other").alias("estimated_attention"),
    )


def fx_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame_id"),
        ((F.col("l_partkey") * 37) % 360).cast("double").alias("direction"),
        (F.col("l_tax") * F.lit(25.0)).alias("speed"),
        F.when(F.col("l_linestatus") == "O", "towards_billboard").otherwise("away_from_billboard").alias("trajectory"),
    )


def fx_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx_base(spark, sf_dir)
    k = F.col("k")
    etype = (
        F.when(F.col("src") == "view", "content_start").when(F.col("src") == "signup", "content_end")
        .when(F.col("src") == "click", "interaction").otherwise("other")
    )
    return b.select(
        F.concat(F.lit("dev_"), _s("user_id")).alias("device_id"),
        "event_id",
        "ts_us",
        etype.alias("event_type"),
        F.concat(F.lit("content_"), (k % 3).cast("string")).alias("content_id"),
        (F.lit(15000) + F.lit(5000) * (k % 4)).alias("planned_ms"),
        F.floor(F.col("value") * F.lit(400.0)).cast("bigint").alias("actual_ms"),
    )


def fx_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx_base(spark, sf_dir)
    return b.where(F.col("src").isin("view", "click")).select(
        F.concat(_s("user_id"), F.lit("/"), (F.col("k") % 5).cast("string")).alias("page_id"),
        "event_id",
        "ts_us",
        (F.col("value") * F.lit(10.0)).alias("scroll_y"),
        F.lit(2000.0).alias("page_h"),
        F.lit(800.0).alias("viewport_h"),
    )


BUTTON_LABELS = ["Add to Cart", "Buy Now", "Checkout", "Learn more", "Add to bag", "Purchase"]


def fx_button(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx_base(spark, sf_dir)
    k = F.col("k")
    label = F.element_at(F.array(*[F.lit(x) for x in BUTTON_LABELS]), (k % 6 + 1).cast("int"))
    return b.where(F.col("src") == "click").select(
        "event_id",
        "user_id",
        "ts_us",
        label.alias("label"),
        F.when(k % 7 == 0, "add-to-cart").otherwise("").alias("css_class"),
    )


def fx_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links on pages.  ``page_url`` is the url of page ``page_id - 1``
    (an equi-join, so no single-partition window is needed)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    prev = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("page_url"))
    pid = F.col("page_id")
    return pages.join(prev, "page_id", "left").select(
        "page_id",
        F.col("url").alias("href"),
        "page_url",
        F.when(pid % 4 == 0, F.concat("url", F.lit("/report.pdf?v=1")))
        .when(pid % 4 == 1, F.concat("url", F.lit("/data.zip")))
        .otherwise(F.col("url"))
        .alias("download_href"),
    )


# --------------------------------------------------------------------------
# DuckDB side (oracle text)
# --------------------------------------------------------------------------

_K = "cast(json_extract_string(props,'$.k') as bigint)"
_US = "epoch_us(ts)"

DUCK_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_base": (
        f"select event_id, user_id, value, event_type as src, {_K} as k, {_US} as ts_us from events",
        (),
    ),
    "fx_envelope": (
        """select concat('evt_', cast(event_id as varchar)) as event_id,
  case src when 'view' then 'view_venue' when 'error' then 'javascript_error' when 'purchase' then 'purchase'
    when 'signup' then case k % 2 when 0 then 'favorite' else 'share' end
    else case k % 4 when 0 then 'add_to_cart' when 1 then 'tag_interaction' when 2 then 'search' else 'map_move' end end as event_type,
  concat('venue_', cast(k as varchar)) as entity_id, ts_us,
  ts_us + case when k % 10 = 0 then 7200000000 else 1000000 end as ingest_us,
  concat('anon-', cast(user_id as varchar)) as uuid,
  case user_id % 5 when 0 then 'web' when 1 then 'react-native' when 2 then 'ios' when 3 then 'android' else 'node' end as platform,
  case k % 6 when 0 then 'music' when 1 then 'food' when 2 then 'art' when 3 then 'sports' when 4 then 'tech' else 'travel' end as category,
  case k % 3 when 0 then 'instagram' when 1 then 'email' else null end as utm_source,
  40e0 + (k % 10) / 10e0 as lat, -74e0 + (user_id % 10) / 10e0 as lng, value as amount, k
from fx_base""",
        ("fx_base",),
    ),
    "fx_consent": (
        """select concat('anon-', cast(user_id as varchar)) as uuid, ts_us,
  case k % 3 when 0 then 'opt_out' else 'opt_in' end as change
from fx_base where src = 'signup' and k % 3 < 2""",
        ("fx_base",),
    ),
    "fx_frame": (
        """select concat('bb_', cast(user_id % 5 as varchar)) as billboard_id, event_id as frame_id,
  1704067200000000 + cast(floor((ts_us - 1704067200000000) / 600e0) as bigint) as ts_us, ts_us as ts_us_raw,
  k % 20 as cluster_count, k % 30 as total_people, value / 100e0 as avg_density,
  case k % 8 when 0 then 'north' when 1 then 'northeast' when 2 then 'east' when 3 then 'southeast' when 4 then 'south'
    when 5 then 'southwest' when 6 then 'west' else 'northwest' end as flow_direction,
  value as dwell_avg, (k % 10) / 10e0 as engagement, (k % 7) / 7e0 as attention, k % 50 + 10 as processing_ms
from fx_base""",
        ("fx_base",),
    ),
    "fx_detection": (
        """select l_orderkey as frame_id, l_linenumber as o1, l_partkey as o2, l_suppkey as o3,
  (l_partkey % 41) / 10e0 - 2e0 as x, (l_suppkey % 41) / 10e0 - 2e0 as y, l_quantity / 25e0 as z,
  0.6e0 + l_discount * 4e0 as confidence
from lineitem""",
        (),
    ),
    "fx_point": (
        """select l_orderkey as frame_id, l_linenumber as o1, l_partkey as o2, l_suppkey as o3,
  l_quantity as x, cast(l_suppkey % 21 - 10 as double) as y, (l_partkey % 26) / 10e0 as z from lineitem""",
        (),
    ),
    "fx_pose": (
        """select l_orderkey as frame_id, l_discount * 10e0 as engagement_score,
  case when l_returnflag = 'R' then 'billboard' else 'other' end as estimated_attention from lineitem""",
        (),
    ),
    "fx_movement": (
        """select l_orderkey as frame_id, cast((l_partkey * 37) % 360 as double) as direction, l_tax * 25e0 as speed,
  case when l_linestatus = 'O' then 'towards_billboard' else 'away_from_billboard' end as trajectory from lineitem""",
        (),
    ),
    "fx_play": (
        """select concat('dev_', cast(user_id as varchar)) as device_id, event_id, ts_us,
  case src when 'view' then 'content_start' when 'signup' then 'content_end' when 'click' then 'interaction' else 'other' end as event_type,
  concat('content_', cast(k % 3 as varchar)) as content_id, 15000 + 5000 * (k % 4) as planned_ms,
  cast(floor(value * 400e0) as bigint) as actual_ms
from fx_base""",
        ("fx_base",),
    ),
    "fx_scroll": (
        """select concat(cast(user_id as varchar), '/', cast(k % 5 as varchar)) as page_id, event_id, ts_us,
  value * 10e0 as scroll_y, 2000e0 as page_h, 800e0 as viewport_h
from fx_base where src in ('view', 'click')""",
        ("fx_base",),
    ),
    "fx_button": (
        """select event_id, user_id, ts_us,
  case k % 6 when 0 then 'Add to Cart' when 1 then 'Buy Now' when 2 then 'Checkout' when 3 then 'Learn more'
    when 4 then 'Add to bag' else 'Purchase' end as label,
  case when k % 7 = 0 then 'add-to-cart' else '' end as css_class
from fx_base where src = 'click'""",
        ("fx_base",),
    ),
    "fx_link": (
        """select p.page_id, p.url as href, q.url as page_url,
  case p.page_id % 4 when 0 then concat(p.url, '/report.pdf?v=1') when 1 then concat(p.url, '/data.zip') else p.url end
    as download_href
from pages p left join pages q on q.page_id = p.page_id - 1""",
        (),
    ),
}


def duck_with(*views: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the requested views and their dependencies."""
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for dep in DUCK_VIEWS[v][1]:
            visit(dep)
        order.append(v)

    for v in views:
        visit(v)
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{v} as (\n{DUCK_VIEWS[v][0]}\n)" for v in order) + "\n"


def duck_sql(views: list[str] | tuple[str, ...], ctes: str, body: str, recursive: bool = False) -> str:
    """Oracle text: fixture views, then extra CTEs (``name as (...)`` list
    without leading comma, may be empty), then the final select."""
    if not views:
        if not ctes.strip():
            return body
        return ("with recursive " if recursive else "with ") + ctes.strip() + "\n" + body
    head = duck_with(*views, recursive=recursive)
    if ctes.strip():
        head = head.rstrip() + ",\n" + ctes.strip() + "\n"
    return head + body
