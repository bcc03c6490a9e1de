"""Domain inputs derived from the driver tables (Spark side).

``envelopes`` turns ``fx_envelope`` into the canonical envelope (TIMESTAMP
columns, ``context`` map, ``geo`` struct, ``tags``, ``ttl``) so library
operators run on their real input shape.  Context keys per event type:

* all: category, utm_source (may be absent), entity_id, amount, k
* search: search_query = 'Query ' || k % 13, result_count = k % 7; not on
  the web: filters = JSON object with location 'nyc' when k % 3 = 0 (else
  '') and category when k % 2 = 0; on the web: location = 'nyc' when
  k % 3 = 0 beside the category that all events have
* tag_interaction: tag_id = 'tag_' || category, tag = JSON object when
  k % 2 = 0 else the tag id string
* map_move: interaction_type = move/zoom/filter/center/pan by k % 5,
  zoom_level = k % 18, center_lat = lat, center_lng = lng
* javascript_error: error_message = 'Error ' || k % 5, error_filename =
  'app' || k % 3 || '.js', error_line = k % 50, page_url = entity_id
* purchase: currency 'USD', item_count = k % 4 (0 = absent), items = JSON
  array of k % 3 + 1 items (sku_i, price 1.5 i)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.timeparts import ts_of
from footfall.operators.envelope import ttl_expr
from footfall.sources import fixtures as fx

AS_OF_US = 1709251200000000  # 2024-03-01T00:00:00Z, the fixed "now" of the checks


def ensure_utc(spark: SparkSession) -> None:
    """Dates and ISO texts of the checks are rendered in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    e = fx.fx_envelope(spark, sf_dir)
    k, et = F.col("k"), F.col("event_type")
    n_items = (k % 3 + 1).cast("int")
    items = F.concat(
        F.lit('[{"sku":"sku_1","price":1.5}'),
        F.when(n_items >= 2, F.lit(',{"sku":"sku_2","price":3.0}')).otherwise(F.lit("")),
        F.when(n_items >= 3, F.lit(',{"sku":"sku_3","price":4.5}')).otherwise(F.lit("")),
        F.lit("]"),
    )
    # Plain create_map (null values allowed): no higher-order functions, so
    # the projection stays inside whole-stage codegen.
    entries = {
        "category": F.col("category"),
        "utm_source": F.col("utm_source"),
        "entity_id": F.col("entity_id"),
        "amount": F.col("amount"),
        "k": k,
        "search_query": F.when(et == "search", F.concat(F.lit("Query "), (k % 13).cast("string"))),
        "result_count": F.when(et == "search", k % 7),
        "filters": F.when((et == "search") & (F.col("platform") != "web"), F.concat(
            F.lit('{"location":"'), F.when(k % 3 == 0, "nyc").otherwise(""), F.lit('"'),
            F.when(k % 2 == 0, F.concat(F.lit(',"category":"'), F.col("category"), F.lit('"'))).otherwise(F.lit("")),
            F.lit("}"))),
        "location": F.when((et == "search") & (F.col("platform") == "web") & (k % 3 == 0), F.lit("nyc")),
        "tag_id": F.when(et == "tag_interaction", F.concat(F.lit("tag_"), F.col("category"))),
        "tag": F.when(et == "tag_interaction", F.when(
            k % 2 == 0,
            F.concat(F.lit('{"id":"tag_'), F.col("category"), F.lit('","name":"'), F.col("category"),
                     F.lit('","category":"genre"}')),
        ).otherwise(F.concat(F.lit("tag_"), F.col("category")))),
        "interaction_type": F.when(et == "map_move", F.element_at(
            F.array(*[F.lit(x) for x in ("move", "zoom", "filter", "center", "pan")]), (k % 5 + 1).cast("int"))),
        "zoom_level": F.when(et == "map_move", k % 18),
        "center_lat": F.when(et == "map_move", F.col("lat")),
        "center_lng": F.when(et == "map_move", F.col("lng")),
        "currency": F.when(et == "purchase", F.lit("USD")),
        "item_count": F.when((et == "purchase") & (k % 4 != 0), k % 4),
        "items": F.when(et == "purchase", items),
        "error_message": F.when(et == "javascript_error", F.concat(F.lit("Error "), (k % 5).cast("string"))),
        "error_filename": F.when(et == "javascript_error", F.concat(F.lit("app"), (k % 3).cast("string"), F.lit(".js"))),
        "error_line": F.when(et == "javascript_error", k % 50),
        "page_url": F.when(et == "javascript_error", F.col("entity_id")),
    }
    ctx = F.create_map(*[x for key, v in entries.items() for x in (F.lit(key), v.cast("string"))])
    day = F.floor(F.col("ts_us") / F.lit(86400000000)).cast("bigint")
    return e.select(
        "event_id",
        "event_type",
        "entity_id",
        ts_of("ts_us").alias("ts"),
        ts_of("ingest_us").alias("ingest_ts"),
        "uuid",
        F.concat(F.col("uuid"), F.lit("-"), day.cast("string")).alias("session_id"),
        F.concat(F.lit("client-"), F.col("platform")).alias("client_id"),
        "platform",
        F.lit(None).cast("string").alias("device_id"),
        F.lit(None).cast("string").alias("location_id"),
        ctx.alias("context"),
        F.struct(F.col("lat"), F.col("lng"), F.lit(None).cast("double").alias("accuracy"),
                 ts_of("ts_us").alias("ts")).alias("geo"),
        F.array(F.col("category")).alias("tags"),
        ttl_expr(F.col("platform"), F.col("event_type")).alias("ttl"),
        "ts_us",
        "k",
    )


def as_of() -> F.Column:
    return F.timestamp_micros(F.lit(AS_OF_US))


# ---- DuckDB twins of the derived columns ---------------------------------
DUCK_TTL = """(case
  when platform in ('web', 'react-native') then case event_type when 'view_venue' then 180 when 'view_event' then 180
      when 'favorite' then 365 when 'search' then 90 when 'map_move' then 30 when 'map_zoom' then 30
      when 'impression' then 30 when 'session_start' then 30 else 90 end
  when platform = 'node' then case event_type when 'impression' then 30 when 'dwell_time' then 30
      when 'interaction' then 90 when 'content_start' then 30 when 'content_end' then 30
      when 'system_event' then 30 else 30 end
  else case event_type when 'screen_view' then 180 when 'button_tap' then 180 when 'purchase' then 365
      when 'search' then 90 when 'app_foreground' then 30 when 'app_background' then 30 else 90 end
end) * 86400"""
DUCK_TTL = f"cast({DUCK_TTL} as integer)"

DUCK_SESSION = "concat(uuid, '-', cast(ts_us // 86400000000 as varchar))"


# ---- frame-time helpers ---------------------------------------------------
FRAME_AS_OF_US = 1704070800000000  # 2024-01-01T01:00:00Z on the compressed frame clock


def frame_clock(us_col: str = "ts_us") -> F.Column:
    """The fx_frame time compression applied to any fx_base row."""
    return F.lit(fx.EPOCH_2024_US) + F.floor((F.col(us_col) - F.lit(fx.EPOCH_2024_US)) / F.lit(600.0)).cast("bigint")


DUCK_FRAME_CLOCK = "1704067200000000 + cast(floor((ts_us - 1704067200000000) / 600e0) as bigint)"


def mode_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privacy-mode switches per billboard: every signup row of fx_base
    switches its billboard to strict / balanced / minimal by k % 3."""
    b = fx.fx_base(spark, sf_dir).where(F.col("src") == "signup")
    return b.select(
        F.concat(F.lit("bb_"), (F.col("user_id") % 5).cast("string")).alias("billboard_id"),
        ts_of(frame_clock()).alias("ts"),
        F.element_at(F.array(F.lit("strict"), F.lit("balanced"), F.lit("minimal")), (F.col("k") % 3 + 1).cast("int"))
        .alias("mode"),
        F.col("event_id").alias("frame_id"),
    )


DUCK_MODES = f"""modes as (select 'bb_' || cast(user_id % 5 as varchar) as billboard_id, {DUCK_FRAME_CLOCK} as ts_us,
  case k % 3 when 0 then 'strict' when 1 then 'balanced' else 'minimal' end as mode, event_id
  from fx_base where src = 'signup')"""


def weather_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather observations per billboard location: every error row of
    fx_base reports sunny / cloudy / rainy / snowy by k % 4."""
    b = fx.fx_base(spark, sf_dir).where(F.col("src") == "error")
    return b.select(
        F.concat(F.lit("bb_"), (F.col("user_id") % 5).cast("string")).alias("billboard_id"),
        ts_of(frame_clock()).alias("ts"),
        F.element_at(F.array(*[F.lit(x) for x in ("sunny", "cloudy", "rainy", "snowy")]),
                     (F.col("k") % 4 + 1).cast("int")).alias("condition"),
    )


DUCK_WEATHER = f"""wobs as (select 'bb_' || cast(user_id % 5 as varchar) as billboard_id, {DUCK_FRAME_CLOCK} as ts_us,
  case k % 4 when 0 then 'sunny' when 1 then 'cloudy' when 2 then 'rainy' else 'snowy' end as condition
  from fx_base where src = 'error')"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_frame with a TIMESTAMP ``ts``."""
    return fx.fx_frame(spark, sf_dir).withColumn("ts", ts_of("ts_us"))
