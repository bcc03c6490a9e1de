"""Raw web / app interaction logs -> typed events.

The client classifies in the browser; here the same rules run over
collected raw interactions as column expressions.  Rules that emit several
events for one interaction (a link that is also a download, a button that
is both add-to-cart and checkout) produce an array that is exploded — no
join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.jsmath import js_round, safe_div, truthy_str
from footfall.operators.asof import next_row

# Download file extensions (substring match on the lower-cased url)
DOWNLOAD_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".exe", ".dmg", ".pkg"]
# Scroll and video milestones (percent)
SCROLL_MILESTONES = [25, 50, 75, 90, 100]
VIDEO_MILESTONES = [25, 50, 75, 95]
# Map interaction kinds
MAP_KINDS = ["move", "zoom", "filter", "center"]


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def element_text(df: DataFrame) -> Column:
    """First truthy of textContent, innerText, value, alt, title; else ''."""
    return F.coalesce(*[truthy_str(_col(df, c)) for c in ("text_content", "inner_text", "value", "alt", "title")],
                      F.lit(""))


def is_download(url: Column) -> Column:
    """C3 rule: the lower-cased url *contains* a download extension."""
    lu = F.lower(url)
    cond = F.lit(False)
    for ext in DOWNLOAD_EXTENSIONS:
        cond = cond | lu.contains(ext)
    return url.isNotNull() & cond


def file_name(url: Column) -> Column:
    """Last ``/`` segment, cut at the first ``?``."""
    return F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), 1)


def file_extension(url: Column) -> Column:
    name = file_name(url)
    return F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """Host of a url (NULL when it does not parse), lower-cased."""
    return F.lower(F.call_function("try_parse_url", url, F.lit("HOST")))


def detect_download(df: DataFrame, url: str = "href") -> DataFrame:
    """Download facts for urls that contain a download extension."""
    u = F.col(url)
    return df.where(is_download(u)).withColumn("file_name", file_name(u)).withColumn("file_extension",
                                                                                      file_extension(u))


def link_features(df: DataFrame, url: str = "href", page_url: str = "page_url") -> DataFrame:
    """Link host and whether it differs from the page host."""
    return df.withColumn("link_domain", url_host(F.col(url))) \
        .withColumn("is_external", url_host(F.col(url)) != url_host(F.col(page_url)))


def commerce_types(text: Column, css_class: Column, data_action: Column) -> tuple[Column, Column]:
    """C4: (is add_to_cart, is checkout_started) — both may fire."""
    t = F.lower(text)
    has_class = F.array_contains(F.split(F.coalesce(css_class, F.lit("")), r"\s+"), "add-to-cart")
    cart = t.contains("add to cart") | t.contains("add to bag") | has_class | (F.coalesce(data_action, F.lit("")) ==
                                                                               "add-to-cart")
    checkout = t.contains("checkout") | t.contains("buy now") | t.contains("purchase")
    return cart, checkout


def detect_commerce(df: DataFrame) -> DataFrame:
    """C4 as rows: one row per commerce event an interaction triggers."""
    cart, checkout = commerce_types(element_text(df), _col(df, "css_class"), _col(df, "data_action"))
    kinds = F.array_compact(F.array(F.when(cart, F.lit("add_to_cart")), F.when(checkout, F.lit("checkout_started"))))
    return df.withColumn("commerce_event", F.explode(kinds)).withColumn("button_text", element_text(df))


def product_id(df: DataFrame) -> Column:
    """Own data-product-id, own data-id, closest ancestor's
    data-product-id, else ''."""
    return F.coalesce(truthy_str(_col(df, "data_product_id")), truthy_str(_col(df, "data_id")),
                      truthy_str(_col(df, "ancestor_product_id")), F.lit(""))


def classify_click(df: DataFrame, track_links: bool = True, track_clicks: bool = True,
                   track_downloads: bool = True, track_commerce: bool = True) -> DataFrame:
    """Every raw click becomes ``link_click`` (href present and link
    tracking on) or ``click``; label truncated to 100 characters.  A
    download link also emits ``download``; commerce buttons also emit
    ``add_to_cart`` / ``checkout_started`` (additional, not exclusive)."""
    href = truthy_str(_col(df, "href"))
    text = element_text(df)
    base = F.when(F.lit(track_links) & href.isNotNull(), F.lit("link_click")).when(F.lit(track_clicks),
                                                                                   F.lit("click"))
    cart, checkout = commerce_types(text, _col(df, "css_class"), _col(df, "data_action"))
    kinds = F.array_compact(F.array(
        base,
        F.when(F.lit(track_downloads) & href.isNotNull() & is_download(href), F.lit("download")),
        F.when(F.lit(track_commerce) & cart, F.lit("add_to_cart")),
        F.when(F.lit(track_commerce) & checkout, F.lit("checkout_started")),
    ))
    return df.withColumn("element_text", F.substring(text, 1, 100)) \
        .withColumn("emitted_type", F.explode(kinds)) \
        .withColumn("product_id", F.when(F.col("emitted_type") == "add_to_cart", product_id(df)))


def search_events(df: DataFrame) -> DataFrame:
    """A submit with a non-blank trimmed query -> ``search``; typing ->
    ``search_input`` only when the trimmed text has >= 3 characters
    (apply :func:`debounce` to the typing rows first)."""
    # All white space, as the clients trim it, not spaces only.
    q = F.regexp_replace(F.col("query_text"), r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")
    kind = F.when((F.col("action") == "submit") & (q != ""), F.lit("search")) \
        .when((F.col("action") == "input") & (F.length(q) >= 3), F.lit("search_input"))
    return df.withColumn("search_type", kind).where(F.col("search_type").isNotNull()) \
        .withColumn("search_query", q)


def debounce(df: DataFrame, key: str | list[str], ts: str = "ts", tie: str = "event_id", wait_ms: int = 1000) -> DataFrame:
    """Trailing-edge debounce — keep an input only when the next input
    on the same element comes ``wait_ms`` or more later (or never)."""
    n = next_row(df, key, ts, [ts, tie], [ts])
    gap_ok = F.col(f"next_{ts}").isNull() | (
        (F.unix_micros(F.col(f"next_{ts}")) - F.unix_micros(F.col(ts))) >= F.lit(wait_ms * 1000))
    return n.where(gap_ok).drop(f"next_{ts}")


def search_flags(df: DataFrame) -> DataFrame:
    """result_count = size(results array) when given, else the
    count field; has_*_filter = the filter value is truthy.  Mobile clients
    send a ``filters`` object, web clients its keys beside the query."""
    ctx = F.col("context")
    results = F.from_json(ctx["results"], "array<string>")
    return df.withColumn("result_count", F.coalesce(F.size(results).cast("int"), ctx["result_count"].try_cast("int"))) \
        .withColumns({f"has_{name}_filter": _filter_set(ctx, name) for name in ("location", "date", "category")})


def _filter_set(ctx: Column, name: str) -> Column:
    value = F.when(ctx["filters"].isNotNull(), F.get_json_object(ctx["filters"], f"$.{name}")).otherwise(ctx[name])
    return truthy_str(value).isNotNull() & ~value.isin("false", "0")


def scroll_milestones(df: DataFrame, page: str = "page_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """pct = JS-round(scrollY / (page height − viewport) · 100); each of
    25/50/75/90/100 fires once per page instance at the first event with
    pct >= it, with ``time_to_depth`` from the page's first event.

    Threshold x event rows are reduced with ``min_by`` per (page,
    threshold): a partial aggregate, no window over the page."""
    pct = js_round(safe_div(F.col("scroll_y").cast("double"), F.col("page_h") - F.col("viewport_h")) * 100)
    ev = df.withColumn("_pct", pct).where(F.col("_pct").isNotNull())
    starts = df.groupBy(page).agg(F.min(ts).alias("_page_start"))
    th = ev.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in SCROLL_MILESTONES]))) \
        .where(F.col("_pct") >= F.col("threshold"))
    first = th.groupBy(page, "threshold").agg(
        F.min_by(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("event_id"), F.col("scroll_y").alias("scroll_y")),
                 F.struct(F.col(ts), F.col(tie))).alias("f"))
    return first.join(starts, page).select(
        page, F.col("threshold").alias("scroll_percentage"), F.col("f.event_id").alias("event_id"),
        F.col("f.ts").alias("ts"), F.col("f.scroll_y").alias("scroll_position"),
        ((F.unix_micros("f.ts") - F.unix_micros("_page_start")) / F.lit(1000.0)).alias("time_to_depth_ms"))


def video_milestones(df: DataFrame, video: str = "video_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """pct = JS-round(100 · t / duration) on ``timeupdate`` rows with
    duration > 0; 25/50/75/95 fire once per video at the first qualifying
    row."""
    ok = (F.col("action") == "timeupdate") & (F.col("duration_s") > 0)
    pct = js_round(F.col("current_time_s") / F.col("duration_s") * 100)
    ev = df.where(ok).withColumn("_pct", pct)
    th = ev.withColumn("milestone", F.explode(F.array(*[F.lit(t) for t in VIDEO_MILESTONES]))) \
        .where(F.col("_pct") >= F.col("milestone"))
    return th.groupBy(video, "milestone").agg(
        F.min_by(F.col(tie), F.struct(F.col(ts), F.col(tie))).alias("event_id"), F.min(ts).alias("ts"))


def first_form_touch(df: DataFrame, form: str = "form_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """C11: one ``form_interaction`` per form instance, the first touch
    wins (a focus before the submit suppresses the submit)."""
    return df.groupBy(form).agg(
        F.min_by(F.struct(F.col(tie).alias("event_id"), F.col("action_type").alias("action_type"),
                          F.col(ts).alias("ts")), F.struct(F.col(ts), F.col(tie))).alias("f")) \
        .select(form, "f.*")


def perf_metrics(df: DataFrame) -> DataFrame:
    """Navigation-timing differences (ms)."""
    c = F.col
    return df.withColumn("dns_lookup", c("domain_lookup_end") - c("domain_lookup_start")) \
        .withColumn("tcp_connection", c("connect_end") - c("connect_start")) \
        .withColumn("server_response", c("response_end") - c("request_start")) \
        .withColumn("dom_processing", c("dom_complete") - c("dom_loading")) \
        .withColumn("page_load", c("load_event_end") - c("navigation_start"))


def perf_rollup(perf: DataFrame, by: str = "page_url", accuracy: int = 10000) -> DataFrame:
    """C12 rollup (ours): p50 / p95 page load and dns per page, approximate
    (mergeable) percentiles."""
    return perf.groupBy(by).agg(
        F.count(F.lit(1)).alias("loads"),
        F.percentile_approx("page_load", [0.5, 0.95], accuracy).alias("page_load_p50_p95"),
        F.percentile_approx("dns_lookup", [0.5, 0.95], accuracy).alias("dns_p50_p95"))


def error_rollup(df: DataFrame, approx: bool = False) -> DataFrame:
    """JS errors and promise rejections (message defaults to 'Unknown
    promise rejection') grouped by message, file, line and page."""
    ctx = F.col("context")
    msg = F.when(F.col("event_type") == "promise_rejection",
                 F.coalesce(truthy_str(ctx["error_message"]), F.lit("Unknown promise rejection"))) \
        .otherwise(ctx["error_message"])
    e = df.where(F.col("event_type").isin("javascript_error", "promise_rejection", "error")).select(
        msg.alias("message"), ctx["error_filename"].alias("filename"), ctx["error_line"].try_cast("int").alias("line"),
        ctx["page_url"].alias("page_url"), "uuid")
    users = F.approx_count_distinct("uuid", 0.01) if approx else F.count_distinct("uuid")
    return e.groupBy("message", "filename", "line", "page_url").agg(F.count(F.lit(1)).alias("errors"),
                                                                    users.alias("users"))


def map_type(df: DataFrame) -> DataFrame:
    """C14: one ``map_interaction`` with an interaction type becomes
    map_move / map_zoom / map_filter / map_center (unknown -> map_move);
    centre, zoom, the four bounds and the applied filters (an array; an
    absent or malformed list is empty) are flattened."""
    ctx = F.col("context")
    kind = F.lower(ctx["interaction_type"])
    return df.withColumn("map_event", F.when(kind.isin(*MAP_KINDS), F.concat(F.lit("map_"), kind))
                         .otherwise(F.lit("map_move"))) \
        .withColumn("zoom_level", ctx["zoom_level"].try_cast("double")) \
        .withColumn("center_lat", ctx["center_lat"].try_cast("double")) \
        .withColumn("center_lng", ctx["center_lng"].try_cast("double")) \
        .withColumn("bounds_north", F.get_json_object(ctx["visible_bounds"], "$.north").try_cast("double")) \
        .withColumn("bounds_south", F.get_json_object(ctx["visible_bounds"], "$.south").try_cast("double")) \
        .withColumn("bounds_east", F.get_json_object(ctx["visible_bounds"], "$.east").try_cast("double")) \
        .withColumn("bounds_west", F.get_json_object(ctx["visible_bounds"], "$.west").try_cast("double")) \
        .withColumn("filters_applied", F.coalesce(F.from_json(ctx["filters_applied"], "array<string>"),
                                                  F.array().cast("array<string>")))


def tag_fields(df: DataFrame) -> DataFrame:
    """A tag is a string or an ``{id, name, category}`` object: id =
    tag.id or the string itself; category NULL for strings."""
    t = F.col("context")["tag"]
    is_obj = F.trim(t).startswith("{")
    return df.withColumn("tag_id", F.when(is_obj, F.get_json_object(t, "$.id")).otherwise(t)) \
        .withColumn("tag_name", F.when(is_obj, F.get_json_object(t, "$.name")).otherwise(t)) \
        .withColumn("tag_category", F.when(is_obj, F.get_json_object(t, "$.category")))


def purchase_facts(df: DataFrame) -> DataFrame:
    """Amount (``amount`` or ``total_amount``), currency, item count
    (size of ``items`` when present, else ``item_count``), one row per
    line item (``posexplode_outer`` keeps purchases without items)."""
    ctx = F.col("context")
    items = F.from_json(ctx["items"], "array<struct<sku:string,price:double,quantity:int>>")
    base = df.where(F.col("event_type") == "purchase").select(
        "event_id", "uuid", "ts", F.coalesce(ctx["amount"], ctx["total_amount"]).try_cast("double").alias("amount"),
        F.coalesce(ctx["currency"], F.lit("USD")).alias("currency"),
        F.coalesce(F.size(items).cast("int"), ctx["item_count"].try_cast("int")).alias("item_count"),
        items.alias("_items"))
    return base.select("*", F.posexplode_outer("_items").alias("line_no", "item")).drop("_items") \
        .select("event_id", "uuid", "ts", "amount", "currency", "item_count", "line_no",
                F.col("item.sku").alias("sku"), F.col("item.price").alias("price"))
