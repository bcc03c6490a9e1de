"""S7 — literal lookup tables.  All are tiny, fixed-size dimensions (a few
dozen rows at most), so joining them with ``broadcast`` is safe at any data
scale: their size does not grow with the data.

Fixed values (must equal the client code's constants):
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 24 * 60 * 60

# ---- Fixed values: event vocabularies ------------------------------------
# core SDK (21): view_venue view_event view_content search search_result_click
#   tag_interaction favorite unfavorite share booking map_move map_zoom
#   map_filter map_center app_open app_background session_start session_end
#   impression dwell_time custom
CORE_EVENT_TYPES = [
    "view_venue", "view_event", "view_content", "search", "search_result_click", "tag_interaction",
    "favorite", "unfavorite", "share", "booking", "map_move", "map_zoom", "map_filter", "map_center",
    "app_open", "app_background", "session_start", "session_end", "impression", "dwell_time", "custom",
]
# node / DOOH SDK (11): impression dwell_time content_start content_end
#   interaction view_content session_start session_end system_event error custom
NODE_EVENT_TYPES = [
    "impression", "dwell_time", "content_start", "content_end", "interaction", "view_content",
    "session_start", "session_end", "system_event", "error", "custom",
]

# ---- Fixed values: dialect aliases -> canonical event type (ours) --------
EVENT_ALIASES = {
    "page_view": "view_content",
    "venue_view": "view_venue",
    "event_view": "view_event",
    "form_submit": "form_interaction",
    "media_interaction": "video_interaction",
    "billboard_impression": "impression",
    "custom_button_tap": "button_tap",
}

# ---- Fixed values: TTL in seconds by (sdk family, event type) -------------
# core: view_venue 180 d, view_event 180 d, favorite 365 d, search 90 d,
#       map_move 30 d, map_zoom 30 d, impression 30 d, session_start 30 d, else 90 d
# node: impression 30 d, dwell_time 30 d, interaction 90 d, content_start 30 d,
#       content_end 30 d, system_event 30 d, else 30 d
# native (ios, android): screen_view 180 d, button_tap 180 d, purchase 365 d,
#       search 90 d, app_foreground 30 d, app_background 30 d, else 90 d
TTL_DAYS = {
    "core": {"view_venue": 180, "view_event": 180, "favorite": 365, "search": 90,
             "map_move": 30, "map_zoom": 30, "impression": 30, "session_start": 30},
    "node": {"impression": 30, "dwell_time": 30, "interaction": 90, "content_start": 30,
             "content_end": 30, "system_event": 30},
    "native": {"screen_view": 180, "button_tap": 180, "purchase": 365, "search": 90,
               "app_foreground": 30, "app_background": 30},
}
TTL_DEFAULT_DAYS = {"core": 90, "node": 30, "native": 90}
# platform -> sdk family
PLATFORM_FAMILY = {"web": "core", "react-native": "core", "node": "node", "ios": "native", "android": "native"}

# ---- Fixed values: intent-graph edge weights (documented) ----------------
# view 1 · favorite 5 · search 1 · map 1 · impression 1 · tag interaction 1
EDGE_RELATIONS = {
    "view_venue": ("viewed", "venue", 1.0),
    "view_event": ("viewed", "event", 1.0),
    "view_content": ("viewed", "content", 1.0),
    "favorite": ("favorited", "entity", 5.0),
    "search": ("searched", "query", 1.0),
    "tag_interaction": ("interacted:tag", "tag", 1.0),
    "map_move": ("map", "area", 1.0),
    "map_zoom": ("map", "area", 1.0),
    "map_filter": ("map", "area", 1.0),
    "map_center": ("map", "area", 1.0),
    "impression": ("impression", "content", 1.0),
}

# ---- Fixed values: frame retention per privacy mode (seconds) -------------
# strict 300 s · balanced 1800 s · minimal 3600 s
PRIVACY_RETENTION_S = {"strict": 300, "balanced": 1800, "minimal": 3600}

# ---- Fixed values: weather factors (crowd, dwell, engagement bonus) -------
# sunny 1.2 1.1 0.1 · cloudy 1.0 1.0 0.0 · rainy 0.6 0.8 -0.2 · snowy 0.4 0.7 -0.1
WEATHER_FACTORS = {
    "sunny": (1.2, 1.1, 0.1),
    "cloudy": (1.0, 1.0, 0.0),
    "rainy": (0.6, 0.8, -0.2),
    "snowy": (0.4, 0.7, -0.1),
}

# ---- Fixed values: sensors (max range m, horizontal field of view deg) ----
# default configuration: max range 50, fov 40
DEFAULT_MAX_RANGE = 50.0
DEFAULT_FOV = 40.0
# intel_realsense_d435 10 m · intel_realsense_d455 20 m · ouster_os1 120 m · ouster_os0 50 m · hesai_pandar_qt 20 m, 360 deg
SENSORS = {
    "intel_realsense_d435": (10.0, DEFAULT_FOV),
    "intel_realsense_d455": (20.0, DEFAULT_FOV),
    "ouster_os1": (120.0, DEFAULT_FOV),
    "ouster_os0": (50.0, DEFAULT_FOV),
    "hesai_pandar_qt": (20.0, 360.0),
}

# ---- Fixed values: content schedule (pos, id, priority, minCrowd, maxCrowd,
# minEngagement, lowEngagement, timeOfDay, revenue, duration ms) ------------
# 0 premium_fashion high 8 - 0.6 - - 500 15000
# 1 tech_startup medium 5 - - - - 200 12000
# 2 local_restaurant medium 3 - - - morning,afternoon 100 10000
# 3 public_service low 1 - - - - 0 8000
# 4 attention_grabber medium - 3 - true - 50 20000
CONTENT_SCHEDULE = [
    (0, "premium_fashion", "high", 8, None, 0.6, None, None, 500.0, 15000),
    (1, "tech_startup", "medium", 5, None, None, None, None, 200.0, 12000),
    (2, "local_restaurant", "medium", 3, None, None, None, ["morning", "afternoon"], 100.0, 10000),
    (3, "public_service", "low", 1, None, None, None, None, 0.0, 8000),
    (4, "attention_grabber", "medium", None, 3, None, True, None, 50.0, 20000),
]
CONTENT_SCHEMA = (
    "pos int, content_id string, priority string, min_crowd int, max_crowd int, "
    "min_engagement double, low_engagement boolean, time_of_day array<string>, revenue double, duration_ms int"
)
# revenue estimate per impression used by the performance summary
REVENUE_PER_IMPRESSION = 150


def sensor_limits(sensor: Column) -> tuple[Column, Column]:
    """(max range, field of view) of a sensor name column; an unknown sensor has the default ones."""
    def pick(i):
        table = F.create_map(*[F.lit(x) for name, limits in SENSORS.items() for x in (name, limits[i])])
        return F.coalesce(table[sensor], F.lit((DEFAULT_MAX_RANGE, DEFAULT_FOV)[i]))

    return pick(0), pick(1)
