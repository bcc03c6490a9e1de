"""P9 typed views of families whose events the driver tables do not hold:
every event sends the family's payload under the keys of the clients."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import envelope as EV
from footfall.plans import inputs as I
from footfall.plans.registry import register
from footfall.sources.fixtures import duck_sql

# Payload keys by family, as the clients send them, with the kind of
# value they carry here: text, whole or fractional number, flag.
PAYLOADS = {
    "app_open": "url:t title:t path:t referrer:t user_agent:t viewport_width:n screen_height:n pixel_ratio:f timezone:t cookie_enabled:b",
    "view_content": "url:t title:t path:t referrer:t search:t hash:t",
    "scroll_depth": "scroll_percentage:n page_height:f scroll_position:f time_to_depth:l",
    "click": "element_tag:t element_href:t element_type:t x_position:f y_position:f page_x:f page_y:f",
    "video_interaction": "video_src:t video_duration:f action:t video_width:n video_id:t",
    "video_milestone": "video_id:t milestone_percentage:n page_url:t",
    "download": "download_url:t file_name:t file_extension:t link_text:t",
    "search_input": "search_partial:t input_length:n page_url:t",
    "dwell_time": "dwell_time_ms:l dwell_time_seconds:l estimated_viewers:n location_id:t",
    "content_end": "content_id:t planned_duration:l actual_duration:l completion_rate:f",
    "interaction": "interaction_type:t interaction_time:t location_id:t content_id:t",
    "billboard_dwell_analysis": "billboard_id:t avg_dwell_time_ms:f peak_concurrency:n time_of_day:t",
    "billboard_content_rotation": "previous_content:t new_content:t trigger_reason:t",
    "billboard_anomaly_detected": "anomaly_type:t severity:t details:t",
    "billboard_privacy_mode_changed": "billboard_id:t new_mode:t",
    "billboard_demographic_settings_changed": "billboard_id:t demographics_enabled:b",
    "billboard_system_diagnostics": "lidar_sensor:t vision_pipeline:t context_analyzer:t storage_usage:t",
    "billboard_lidar_shutdown": "uptime_seconds:f total_frames_processed:l",
}


def _keys(family: str) -> list[list[str]]:
    return [x.split(":") for x in PAYLOADS[family].split()]


def sent_events(spark, sf_dir, family: str, keys: list[list[str]] | None = None):
    """All events as events of ``family``; every seventh number is not a number."""
    k = F.col("k")
    value = {
        "t": lambda key: F.concat(F.lit(f"{key} "), k.cast("string")),
        "n": lambda key: F.when(k % 7 == 0, "n/a").otherwise((k % 97).cast("string")),
        "l": lambda key: F.when(k % 7 == 0, "n/a").otherwise((k * 100000).cast("string")),
        "f": lambda key: F.when(k % 7 == 0, "n/a").otherwise(((k % 97) / F.lit(4.0)).cast("string")),
        "b": lambda key: F.when(k % 2 == 0, "true").otherwise("false"),
    }
    context = F.create_map(*[x for key, kind in keys or _keys(family) for x in (F.lit(key), value[kind](key))])
    return I.envelopes(spark, sf_dir).withColumn("event_type", F.lit(family)).withColumn("context", context)


DUCK_VALUE = {
    "t": "'{key} ' || cast(k as varchar)",
    "n": "case when k % 7 <> 0 then cast(k % 97 as integer) end",
    "l": "case when k % 7 <> 0 then k * 100000 end",
    "f": "case when k % 7 <> 0 then (k % 97) / 4e0 end",
    "b": "k % 2 = 0",
}


def _register(family: str) -> None:
    columns = ", ".join(f"{DUCK_VALUE[kind].format(key=key)} as {key}" for key, kind in _keys(family))

    @register(f"typed_{family}", duck_sql(["fx_envelope"], "", f"select event_id, {columns} from fx_envelope"))
    def query(spark, sf_dir):
        view = EV.typed_view(sent_events(spark, sf_dir, family), family, keep=("event_id",))
        return view.select("event_id", *[key for key, _ in _keys(family)])


for _family in PAYLOADS:
    _register(_family)


# Families of the mobile and signage clients: what is sent, and, apart from it, the oracle's text with the clients' keys.
SENT = {
    "content_view": "content_id:t content_type:t content_name:t",
    "screen_view": "screen_name:t",
    "button_tap": "button_title:t button_text:t",
    "view_event": "event_name:t event_date:t venue_id:t category:t price:f",
    "favorite": "entity_type:t entity_name:t",
    "share": "entity_type:t share_platform:t",
    "tag_interaction": "tag_id:t tag_name:t tag_category:t interaction_type:t",
    "impression": "content_id:t content_duration:l estimated_viewers:n display_time:t",
    "content_start": "content_id:t content_duration:l start_time:t",
    "system_event": "system_event_type:t",
}
ORACLES = {
    "content_view": "concat('content_id ', k) as content_id, concat('content_type ', k) as content_type, concat('content_name ', k) as content_name",
    "screen_view": "concat('screen_name ', k) as screen_name",
    "button_tap": "concat('button_title ', k) as button_title, concat('button_text ', k) as button_text",
    "view_event": "concat('event_name ', k) as event_name, concat('event_date ', k) as event_date, concat('venue_id ', k) as venue_id, "
                  "concat('category ', k) as category, case when k % 7 <> 0 then (k % 97) / 4e0 end as price",
    "favorite": "concat('entity_type ', k) as entity_type, concat('entity_name ', k) as entity_name",
    "share": "concat('entity_type ', k) as entity_type, concat('share_platform ', k) as share_platform",
    "tag_interaction": "concat('tag_id ', k) as tag_id, concat('tag_name ', k) as tag_name, concat('tag_category ', k) as tag_category, "
                       "concat('interaction_type ', k) as interaction_type",
    "impression": "concat('content_id ', k) as content_id, case when k % 7 <> 0 then k * 100000 end as content_duration, "
                  "case when k % 7 <> 0 then cast(k % 97 as integer) end as estimated_viewers, concat('display_time ', k) as display_time",
    "content_start": "concat('content_id ', k) as content_id, case when k % 7 <> 0 then k * 100000 end as content_duration, "
                     "concat('start_time ', k) as start_time",
    "system_event": "concat('system_event_type ', k) as system_event_type",
}


def _register_named(family: str) -> None:
    keys = [x.split(":") for x in SENT[family].split()]

    @register(f"typed_{family}", duck_sql(["fx_envelope"], "", f"select event_id, {ORACLES[family]} from fx_envelope"))
    def query(spark, sf_dir):
        view = EV.typed_view(sent_events(spark, sf_dir, family, keys), family, keep=("event_id",))
        return view.select("event_id", *[key for key, _ in keys])


for _family in SENT:
    _register_named(_family)
