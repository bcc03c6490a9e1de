"""Interaction-classification queries (C1–C16) over the click, link,
scroll, playback and envelope fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions.jsmath import round6
from footfall.functions.timeparts import ts_of
from footfall.operators import classify as CL
from footfall.operators import sketches as SK
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.session import materialize
from footfall.sources import fixtures as fx
from footfall.sources.fixtures import duck_sql

US = F.unix_micros


def raw_clicks(spark, sf_dir):
    b = fx.fx_button(spark, sf_dir).select(
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("click_id"),
        F.lit(None).cast("string").alias("href"), F.col("label").alias("text_content"),
        F.lit(None).cast("string").alias("inner_text"), "css_class", F.lit(None).cast("string").alias("data_action"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("data_product_id"),
        F.lit("").alias("data_id"), F.concat(F.lit("anc"), F.col("user_id").cast("string")).alias("ancestor_product_id"))
    lk = fx.fx_link(spark, sf_dir).select(
        F.concat(F.lit("l"), F.col("page_id").cast("string")).alias("click_id"), F.col("download_href").alias("href"),
        F.lit("").alias("text_content"), F.concat(F.lit("Link "), F.col("page_id").cast("string")).alias("inner_text"),
        F.lit("").alias("css_class"), F.lit(None).cast("string").alias("data_action"),
        F.lit(None).cast("string").alias("data_product_id"), F.lit(None).cast("string").alias("data_id"),
        F.lit(None).cast("string").alias("ancestor_product_id"))
    return b.unionByName(lk)


_DL = " or ".join(f"contains(lower(h), '{e}')" for e in CL.DOWNLOAD_EXTENSIONS)
DUCK_CLICKS = f"""raw as (
  select 'b' || cast(event_id as varchar) as click_id, cast(null as varchar) as href, label as text_content,
    cast(null as varchar) as inner_text, css_class, cast(null as varchar) as data_action,
    case when event_id % 3 = 0 then 'p' || cast(event_id as varchar) end as data_product_id, '' as data_id,
    'anc' || cast(user_id as varchar) as ancestor_product_id from fx_button
  union all
  select 'l' || cast(page_id as varchar), download_href, '', 'Link ' || cast(page_id as varchar), '', null, null, null, null
  from fx_link),
r2 as (select *, coalesce(nullif(text_content, ''), nullif(inner_text, ''), '') as txt, nullif(href, '') as h from raw),
r3 as (select *,
  (contains(lower(txt), 'add to cart') or contains(lower(txt), 'add to bag')
    or list_contains(string_split_regex(coalesce(css_class, ''), '\\s+'), 'add-to-cart')
    or coalesce(data_action, '') = 'add-to-cart') as cart,
  (contains(lower(txt), 'checkout') or contains(lower(txt), 'buy now') or contains(lower(txt), 'purchase')) as chk
  from r2),
em as (select *, unnest(list_filter([case when h is not null then 'link_click' else 'click' end,
  case when h is not null and ({_DL}) then 'download' end, case when cart then 'add_to_cart' end,
  case when chk then 'checkout_started' end], lambda x: x is not null)) as emitted_type from r3)"""


@register("classify_click", duck_sql(["fx_base", "fx_button", "fx_link"], DUCK_CLICKS, """
select click_id, emitted_type, substr(txt, 1, 100) as element_text,
  case when emitted_type = 'add_to_cart' then coalesce(nullif(data_product_id, ''), nullif(data_id, ''),
    nullif(ancestor_product_id, ''), '') end as product_id from em"""))
def q_classify_click(spark, sf_dir):
    c = CL.classify_click(raw_clicks(spark, sf_dir))
    return c.select("click_id", "emitted_type", "element_text", "product_id")


_HOST = "nullif(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '')"


@register("link_features", duck_sql(["fx_link"], "", f"""
select page_id, href, {_HOST.format(u='href')} as link_domain,
  {_HOST.format(u='href')} <> {_HOST.format(u='page_url')} as is_external from fx_link"""))
def q_link_features(spark, sf_dir):
    return CL.link_features(fx.fx_link(spark, sf_dir)).select("page_id", "href", "link_domain", "is_external")


@register("detect_download", duck_sql(["fx_link"], "", f"""
select page_id, string_split(string_split(h, '/')[-1], '?')[1] as file_name,
  case when contains(string_split(string_split(h, '/')[-1], '?')[1], '.')
    then string_split(string_split(string_split(h, '/')[-1], '?')[1], '.')[-1] else '' end as file_extension
from (select page_id, download_href as h from fx_link) t where {_DL}"""))
def q_detect_download(spark, sf_dir):
    d = CL.detect_download(fx.fx_link(spark, sf_dir), "download_href")
    return d.select("page_id", "file_name", "file_extension")


@register("detect_commerce", duck_sql(["fx_base", "fx_button"], "", """
select event_id, commerce_event, label as button_text from (
  select *, unnest(list_filter([case when contains(lower(label), 'add to cart') or contains(lower(label), 'add to bag')
      or list_contains(string_split_regex(css_class, '\\s+'), 'add-to-cart') then 'add_to_cart' end,
    case when contains(lower(label), 'checkout') or contains(lower(label), 'buy now')
      or contains(lower(label), 'purchase') then 'checkout_started' end], lambda x: x is not null)) as commerce_event
  from fx_button) t"""))
def q_detect_commerce(spark, sf_dir):
    b = fx.fx_button(spark, sf_dir).withColumnRenamed("label", "text_content")
    return CL.detect_commerce(b).select("event_id", "commerce_event", "button_text")


def search_raw(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).where(F.col("event_type") == "search")
    k = F.col("k")
    text = F.when(k % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.substring(
        F.concat(F.lit("Query "), (k % 13).cast("string")), 1, (k % 8).cast("int")), F.lit(" ")))
    return env.select("event_id", "uuid", "ts", "k", F.when(k % 3 == 0, "submit").otherwise("input").alias("action"),
                      text.alias("query_text"))


_DUCK_SEARCH_RAW = """sr as (select event_id, uuid, ts_us, k, case when k % 3 = 0 then 'submit' else 'input' end as action,
  case when k % 5 = 0 then '   ' else concat(' ', substr(concat('Query ', cast(k % 13 as varchar)), 1, k % 8), ' ') end
    as query_text from fx_envelope where event_type = 'search')"""


@register("search_events", duck_sql(["fx_envelope"], _DUCK_SEARCH_RAW, """
select event_id, search_type, trim(query_text) as search_query from (select *,
  case when action = 'submit' and trim(query_text) <> '' then 'search'
    when action = 'input' and length(trim(query_text)) >= 3 then 'search_input' end as search_type from sr) t
where search_type is not null"""))
def q_search_events(spark, sf_dir):
    return CL.search_events(search_raw(spark, sf_dir)).select("event_id", "search_type", "search_query")


@register("debounce", duck_sql(["fx_envelope"], _DUCK_SEARCH_RAW + """,
ks as (select concat(event_id, '#', cast(i as varchar)) as key_id, uuid,
  ts_us + i * 700000 + (i % 2) * 600000 as ts_us from sr, unnest(range(1, k % 4 + 2)) as r(i)),
nx as (select *, lead(ts_us) over (partition by uuid order by ts_us, key_id) as nts from ks)""", """
select key_id, uuid, ts_us from nx where nts is null or nts - ts_us >= 1000000"""))
def q_debounce(spark, sf_dir):
    s = search_raw(spark, sf_dir)
    ks = s.select("event_id", "uuid", "ts", F.explode(F.sequence(F.lit(1), (F.col("k") % 4 + 1).cast("int")))
                  .alias("i")).select(
        F.concat(F.col("event_id"), F.lit("#"), F.col("i").cast("string")).alias("key_id"), "uuid",
        F.timestamp_micros(F.unix_micros("ts") + F.col("i") * 700000 + (F.col("i") % 2) * 600000).alias("ts"))
    d = CL.debounce(ks, "uuid", "ts", "key_id", 1000)
    return d.select("key_id", "uuid", US("ts").alias("ts_us"))


@register("search_flags", duck_sql(["fx_envelope"], "", """
select event_id, cast(k % 7 as integer) as result_count, k % 3 = 0 as has_location_filter, false as has_date_filter,
  platform = 'web' or k % 2 = 0 as has_category_filter from fx_envelope where event_type = 'search'"""))
def q_search_flags(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).where(F.col("event_type") == "search")
    return CL.search_flags(env).select("event_id", "result_count", "has_location_filter", "has_date_filter",
                                       "has_category_filter")


@register("scroll_milestones", duck_sql(["fx_base", "fx_scroll"], """
sp as (select *, cast(floor(cast(scroll_y as double) / nullif(page_h - viewport_h, 0) * 100 + 0.5) as bigint) as pct from fx_scroll),
st as (select page_id, min(ts_us) as s0 from fx_scroll group by page_id),
th as (select sp.*, t.th from sp cross join (select unnest([25, 50, 75, 90, 100]) as th) t where pct >= t.th),
fm as (select page_id, th, arg_min({'ts': ts_us, 'e': event_id, 'y': scroll_y}, {'ts': ts_us, 'e': event_id}) as f
  from th group by page_id, th)""", """
select fm.page_id, th as scroll_percentage, f.e as event_id, f.ts as ts_us, round(f.y, 6) as scroll_position,
  round((f.ts - st.s0) / 1000e0, 6) as time_to_depth_ms from fm join st on st.page_id = fm.page_id"""))
def q_scroll_milestones(spark, sf_dir):
    s = fx.fx_scroll(spark, sf_dir).withColumn("ts", ts_of("ts_us"))
    m = CL.scroll_milestones(s)
    return m.select("page_id", "scroll_percentage", "event_id", US("ts").alias("ts_us"),
                    round6("scroll_position").alias("scroll_position"), round6("time_to_depth_ms")
                    .alias("time_to_depth_ms"))


def videos(spark, sf_dir):
    p = fx.fx_play(spark, sf_dir)
    return p.select(F.concat("device_id", F.lit("/"), "content_id").alias("video_id"), "event_id",
                    ts_of("ts_us").alias("ts"), (F.col("actual_ms") / F.lit(1000.0)).alias("current_time_s"),
                    (F.col("planned_ms") / F.lit(1000.0)).alias("duration_s"),
                    F.when(F.col("event_type") == "other", "pause").otherwise("timeupdate").alias("action"))


@register("video_milestones", duck_sql(["fx_base", "fx_play"], """
v as (select device_id || '/' || content_id as video_id, event_id, ts_us, actual_ms / 1000e0 as t,
  planned_ms / 1000e0 as d, case when event_type = 'other' then 'pause' else 'timeupdate' end as action from fx_play),
vp as (select *, cast(floor(t / d * 100 + 0.5) as bigint) as pct from v where action = 'timeupdate' and d > 0),
th as (select vp.*, m.ms from vp cross join (select unnest([25, 50, 75, 95]) as ms) m where pct >= m.ms)""", """
select video_id, ms as milestone, arg_min(event_id, {'t': ts_us, 'e': event_id}) as event_id, min(ts_us) as ts_us
from th group by video_id, ms"""))
def q_video_milestones(spark, sf_dir):
    m = CL.video_milestones(videos(spark, sf_dir))
    return m.select("video_id", "milestone", "event_id", US("ts").alias("ts_us"))


@register("form_first_touch", duck_sql(["fx_base", "fx_scroll"], "", """
select page_id as form_id, arg_min(event_id, {'t': ts_us, 'e': event_id}) as event_id,
  arg_min(case when event_id % 2 = 0 then 'submit' else 'field_focus' end, {'t': ts_us, 'e': event_id}) as action_type,
  min(ts_us) as ts_us from fx_scroll group by page_id"""))
def q_form_first_touch(spark, sf_dir):
    s = fx.fx_scroll(spark, sf_dir).select(F.col("page_id").alias("form_id"), "event_id", ts_of("ts_us").alias("ts"),
                                          F.when(F.col("event_id") % 2 == 0, "submit").otherwise("field_focus")
                                          .alias("action_type"))
    f = CL.first_form_touch(s)
    return f.select("form_id", "event_id", "action_type", US("ts").alias("ts_us"))


def timings(spark, sf_dir):
    b = fx.fx_base(spark, sf_dir).where(F.col("src") == "view")
    k, nav = F.col("k"), F.floor(F.col("ts_us") / 1000).cast("bigint")
    return b.select("event_id", "user_id", ts_of("ts_us").alias("ts"), nav.alias("navigation_start"), (nav + 5).alias("domain_lookup_start"),
                    (nav + 5 + k % 20).alias("domain_lookup_end"), (nav + 30).alias("connect_start"),
                    (nav + 30 + k % 40).alias("connect_end"), (nav + 80).alias("request_start"),
                    (nav + 80 + k % 300).alias("response_end"), (nav + 400).alias("dom_loading"),
                    (nav + 400 + k % 900).alias("dom_complete"), (nav + 1400 + k % 500).alias("load_event_end"),
                    F.concat(F.lit("/page/"), (k % 9).cast("string")).alias("page_url"))


@register("page_performance", duck_sql(["fx_base"], "", """
select event_id, k % 20 as dns_lookup, k % 40 as tcp_connection, k % 300 as server_response, k % 900 as dom_processing,
  1400 + k % 500 as page_load from fx_base where src = 'view'"""))
def q_page_performance(spark, sf_dir):
    p = CL.perf_metrics(timings(spark, sf_dir))
    return p.select("event_id", "dns_lookup", "tcp_connection", "server_response", "dom_processing", "page_load")


@register("page_performance_rollup", duck_sql(["fx_base"], "", """
select concat('/page/', k % 9) as page_url, count(*) as loads, quantile_disc(1400 + k % 500, 0.5) as page_load_p50,
  quantile_disc(1400 + k % 500, 0.95) as page_load_p95 from fx_base where src = 'view' group by 1"""))
def q_page_performance_rollup(spark, sf_dir):
    r = CL.perf_rollup(CL.perf_metrics(timings(spark, sf_dir)))
    return r.select("page_url", "loads", F.col("page_load_p50_p95")[0].alias("page_load_p50"),
                    F.col("page_load_p50_p95")[1].alias("page_load_p95"))


@register("page_performance_sketches", duck_sql(["fx_base"], "", """
select concat('/page/', k % 9) as page_url, count(*) as loads, true as p50_in_rank, true as p95_in_rank,
  true as users_in_error from fx_base where src = 'view' and ts_us >= 1704499200000000 and ts_us < 1705708800000000 group by 1"""))
def q_page_performance_sketches(spark, sf_dir):
    """Daily sketches, written and merged for 6 to 19 January: the estimates' exact ranks among the page's loads must
    hold the quantile within 2 %, the distinct users must be within 3 %."""
    perf = CL.perf_metrics(timings(spark, sf_dir))
    daily = materialize(SK.daily_sketches(perf, ["page_url"], ["page_load"], ["user_id"]), "daily-sketches")
    est = SK.estimates(SK.merged(daily, ["page_url"], "2024-01-06", "2024-01-19"), {"p50": 0.5, "p95": 0.95})
    day = F.to_date("ts")
    exact = perf.where((day >= F.lit("2024-01-06").cast("date")) & (day <= F.lit("2024-01-19").cast("date"))).join(est, "page_url")

    def holds(q, name):  # the share below is at most q, the share up to it at least q, give or take the error
        below = F.avg((F.col("page_load") < F.col(f"page_load_{name}")).cast("double"))
        up_to = F.avg((F.col("page_load") <= F.col(f"page_load_{name}")).cast("double"))
        return ((below <= q + 0.02) & (up_to >= q - 0.02)).alias(f"{name}_in_rank")

    users = F.count_distinct("user_id")
    error = F.abs(F.max("user_id_distinct") - users) <= F.greatest(users * 0.03, F.lit(1.0))
    return exact.groupBy("page_url").agg(F.max("n").alias("loads"), holds(0.5, "p50"), holds(0.95, "p95"), error.alias("users_in_error"))


@register("error_rollup", duck_sql(["fx_envelope"], "", """
select 'Error ' || cast(k % 5 as varchar) as message, 'app' || cast(k % 3 as varchar) || '.js' as filename,
  cast(k % 50 as integer) as line, entity_id as page_url, count(*) as errors, count(distinct uuid) as users
from fx_envelope where event_type = 'javascript_error' group by 1, 2, 3, 4"""))
def q_error_rollup(spark, sf_dir):
    return CL.error_rollup(I.envelopes(spark, sf_dir))


@register("map_interaction", duck_sql(["fx_envelope"], "", """
select event_id, case k % 5 when 0 then 'map_move' when 1 then 'map_zoom' when 2 then 'map_filter' when 3 then 'map_center'
  else 'map_move' end as map_event, cast(k % 18 as double) as zoom_level, lat as center_lat, lng as center_lng
from fx_envelope where event_type = 'map_move'"""))
def q_map_interaction(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).where(F.col("event_type") == "map_move")
    return CL.map_type(env).select("event_id", "map_event", "zoom_level", "center_lat", "center_lng")


@register("map_bounds", duck_sql(["fx_envelope"], "", """
select event_id, 41e0 as bounds_north, 39e0 as bounds_south, -73e0 + k % 3 as bounds_east, case when k % 5 <> 0 then -75e0 end as bounds_west,
  case k % 4 when 0 then '' when 1 then category when 2 then category || '|open now' else '' end as filters
from fx_envelope where event_type = 'map_move'"""))
def q_map_bounds(spark, sf_dir):
    """All four bounds (west now and then missing) and the applied filters: none, one, two, or no list at all."""
    env, k = I.envelopes(spark, sf_dir).where(F.col("event_type") == "map_move"), F.col("k")
    bounds = F.to_json(F.struct(F.lit(41.0).alias("north"), F.lit(39.0).alias("south"), (F.lit(-73.0) + k % 3).alias("east"),
                                F.when(k % 5 != 0, F.lit(-75.0)).alias("west")))
    quoted = F.concat(F.lit('["'), F.col("context")["category"], F.lit('"'))
    filters = F.when(k % 4 == 0, "[]").when(k % 4 == 1, F.concat(quoted, F.lit("]"))) \
        .when(k % 4 == 2, F.concat(quoted, F.lit(',"open now"]'))).otherwise("not a list")
    more = F.create_map(F.lit("visible_bounds"), bounds, F.lit("filters_applied"), filters)
    m = CL.map_type(env.withColumn("context", F.map_concat("context", more)))
    return m.select("event_id", "bounds_north", "bounds_south", "bounds_east", "bounds_west",
                    F.array_join("filters_applied", "|").alias("filters"))


@register("tag_interaction", duck_sql(["fx_envelope"], "", """
select event_id, 'tag_' || category as tag_id, case when k % 2 = 0 then category else 'tag_' || category end as tag_name,
  case when k % 2 = 0 then 'genre' end as tag_category from fx_envelope where event_type = 'tag_interaction'"""))
def q_tag_interaction(spark, sf_dir):
    env = I.envelopes(spark, sf_dir).where(F.col("event_type") == "tag_interaction")
    return CL.tag_fields(env).select("event_id", "tag_id", "tag_name", "tag_category")


@register("purchase_facts", duck_sql(["fx_envelope"], "", """
select event_id, amount, 'USD' as currency, cast(k % 3 + 1 as integer) as item_count, cast(i - 1 as integer) as line_no,
  'sku_' || cast(i as varchar) as sku, i * 1.5e0 as price
from fx_envelope, unnest(range(1, k % 3 + 2)) as r(i) where event_type = 'purchase'"""))
def q_purchase_facts(spark, sf_dir):
    p = CL.purchase_facts(I.envelopes(spark, sf_dir))
    return p.select("event_id", "amount", "currency", "item_count", "line_no", "sku", "price")
