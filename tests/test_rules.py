"""Edge rules of governance, envelope, playback and content (FIXTURES §C)."""

from pyspark.sql import functions as F

from footfall.functions.timeparts import hour_of_us, time_of_day
from footfall.operators import content as CT
from footfall.operators import envelope as EV
from footfall.operators import geometry as GM
from footfall.operators import governance as GV
from footfall.operators.sessions import completion_rate
from tests.util import ts


def test_completion_rate_truthiness(spark):
    df = spark.createDataFrame([(0, 100), (100, 0), (150, 100), (50, 100), (None, 100)], "a long, p long")
    got = [r[0] for r in df.select(completion_rate(F.col("a"), F.col("p"))).collect()]
    assert got == [None, None, 1.0, 0.5, None]


def test_entity_id_skips_empty_strings(spark):
    df = spark.createDataFrame([({"entity_id": "", "venue_id": "v1"},), ({"event_id": "e1"},), ({},)],
                               "context map<string,string>")
    got = [r[0] for r in df.select(EV.entity_id_expr(F.col("context"))).collect()]
    assert got == ["v1", "e1", None]


def test_ttl_depends_on_sdk_family(spark):
    df = spark.createDataFrame([("ios", "view_venue"), ("web", "view_venue"), ("node", "anything"),
                                ("android", "purchase"), ("react-native", "favorite")], "platform string, event_type string")
    got = [r["ttl"] // 86400 for r in EV.assign_ttl(df).collect()]
    assert got == [90, 180, 30, 365, 365]


def test_validate_frames_uses_first_point_only(spark):
    pts = spark.createDataFrame(
        [(1, 1, 0, 0, 1.0, 1.0, 0.0), (1, 2, 0, 0, 1.0, 1.0, 1.0),      # first point z = 0 -> invalid
         (2, 1, 0, 0, 1.0, 1.0, 1.0), (2, 2, 0, 0, 0.0, 0.0, 0.0)],     # later zero point is fine
        "frame_id long, o1 int, o2 long, o3 long, x double, y double, z double")
    got = {r["frame_id"]: r["valid"] for r in GM.validate_frames(pts).collect()}
    assert got == {1: False, 2: True}


def test_consent_same_instant_and_flip_flop(spark):
    ev = spark.createDataFrame([("u", "e1", ts(0)), ("u", "e2", ts(10)), ("u", "e3", ts(20)), ("u", "e4", ts(30)),
                                ("v", "e5", ts(5))], "uuid string, event_id string, ts timestamp")
    log = spark.createDataFrame([("u", ts(0), "opt_out"), ("u", ts(15), "opt_in"), ("u", ts(25), "opt_out")],
                                "uuid string, ts timestamp, change string")
    kept = sorted(r["event_id"] for r in GV.apply_consent(ev, log).collect())
    assert kept == ["e3", "e5"]


def test_optout_purges_only_undelivered(spark):
    ev = spark.createDataFrame([("u", "a", ts(0), ts(1)), ("u", "b", ts(0), ts(100)), ("u", "c", ts(60), ts(61))],
                               "uuid string, event_id string, ts timestamp, ingest_ts timestamp")
    log = spark.createDataFrame([("u", ts(50), "opt_out")], "uuid string, ts timestamp, change string")
    kept = sorted(r["event_id"] for r in GV.purge_on_optout(ev, log).collect())
    assert kept == ["a", "c"]


def test_time_of_day_bands(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 12, 17, 21)], "h long")
    us = F.col("h") * 3600 * 1_000_000
    got = [r[0] for r in df.select(time_of_day(hour_of_us(us))).collect()]
    assert got == ["night", "morning", "afternoon", "evening", "night"]


def test_score_ties_and_low_engagement(spark):
    cat = [(0, "a", "medium", None, None, None, None, None, 0.0, 1),
           (1, "b", "medium", None, None, None, None, None, 0.0, 1),
           (2, "c", "low", None, None, None, True, None, 0.0, 1)]
    ctx = spark.createDataFrame([(5, 0.4, "night"), (5, 0.39, "night")],
                                "ctx_cluster_count long, ctx_engagement double, time_of_day string")
    got = [(r["selected_content"], r["selected_score"]) for r in CT.select_content(CT.score_content(ctx, cat))
           .collect()]
    assert got[0] == ("a", 50.0)          # tie a/b -> earliest; 0.4 is not < 0.4, so c stays at 25
    assert got[1] == ("c", 55.0)          # 0.39 < 0.4: c gets the +30 low-engagement bonus


def test_estimated_viewers_rounding(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,)], "c long")
    got = [r[0] for r in df.select(CT.estimated_viewers(F.col("c"))).collect()]
    assert got == [1, 1, 2, 6]


def test_device_clock_repair(spark):
    df = spark.createDataFrame([(ts(0), True, "America/New_York"), (ts(0), True, None), (ts(0), False, None)],
                               "ts timestamp, ts_suspect boolean, device_tz string")
    got = EV.fix_device_clock(df).collect()
    assert (got[0]["ts"] - ts(0)).total_seconds() == 5 * 3600 and got[0]["ts_suspect"] is False
    assert got[1]["ts"] == ts(0) and got[1]["ts_suspect"] is True
    assert got[2]["ts"] == ts(0) and got[2]["ts_suspect"] is False


def test_snapshot_gap_fill_repeats_last(spark):
    from footfall.operators import context as CX
    ctx = spark.createDataFrame(
        [("bb", 1, ts(1), 3, 0.1, "north", 1.0, 0.2), ("bb", 2, ts(21), 5, 0.1, "east", 1.0, 0.2)],
        "billboard_id string, frame_id long, ts timestamp, ctx_cluster_count long, ctx_avg_density double, "
        "ctx_flow_direction string, ctx_dwell_avg double, ctx_engagement double")
    snap = CX.context_snapshot(ctx, 5, fill_gaps=True).orderBy("tick").collect()
    assert [r["cluster_count"] for r in snap] == [3, 3, 3, 3, 5]
    assert [r["repeated"] for r in snap] == [False, True, True, True, False]


def test_unfavorite_cancels_earlier_favorites_only(spark):
    from footfall.operators import graph as G
    rows = [("u", "favorite", "v1", ts(0)), ("u", "unfavorite", "v1", ts(10)), ("u", "favorite", "v1", ts(20)),
            ("u", "favorite", "v2", ts(0)), ("u", "view_venue", "v1", ts(5))]
    df = spark.createDataFrame(rows, "uuid string, event_type string, entity_id string, ts timestamp") \
        .withColumn("context", F.create_map(F.lit("category"), F.lit("music"))) \
        .withColumn("ttl", F.lit(365 * 86400))
    w = G.edge_weights(G.intent_edges(df), F.lit(ts(100)))
    got = {(r["relation"], r["target"]): r["weight"] for r in w.collect()}
    assert got == {("favorited", "v1"): 5.0, ("favorited", "v2"): 5.0, ("viewed", "v1"): 1.0}
