"""Hand tables for the rolling-context edge cases."""

from pyspark.sql import functions as F

from footfall.operators import context as CX
from footfall.operators import geometry as GM
from tests.util import ts

SCHEMA = ("billboard_id string, frame_id bigint, ts timestamp, cluster_count bigint, avg_density double, "
          "flow_direction string, dwell_avg double, engagement double, attention double")


def frames(spark, ccs, flows=None, dens=None, step=1.0):
    flows = flows or ["north"] * len(ccs)
    dens = dens or [0.5] * len(ccs)
    rows = [("bb", i, ts(i * step), c, d, f, 10.0, 0.5, 0.2) for i, (c, f, d) in enumerate(zip(ccs, flows, dens))]
    return spark.createDataFrame(rows, SCHEMA)


def last_ctx(spark, ccs, **kw):
    return CX.recent_context(frames(spark, ccs, **kw)).orderBy(F.col("frame_id").desc()).first()


def test_trend_rules(spark):
    assert last_ctx(spark, [7])["crowd_trend"] == "stable"          # n = 1
    assert last_ctx(spark, [0, 0])["crowd_trend"] == "stable"       # 0 -> 0 is NaN
    assert last_ctx(spark, [0, 5])["crowd_trend"] == "increasing"   # 0 -> 5 is +Infinity
    assert last_ctx(spark, [10, 11])["crowd_trend"] == "stable"     # exactly +10 % is not > 0.1
    assert last_ctx(spark, [10, 12])["crowd_trend"] == "increasing"
    assert last_ctx(spark, [10, 8])["crowd_trend"] == "decreasing"


def test_stability_rules(spark):
    assert last_ctx(spark, [3, 3])["stability"] == "unknown"        # n < 3
    # mean 0: crowd and density stability are 0, flow stability 1 -> 1/3
    r = last_ctx(spark, [0, 0, 0], dens=[0.0, 0.0, 0.0])
    assert r["stability"] == "unstable"
    assert last_ctx(spark, [5, 5, 5, 5])["stability"] == "very_stable"


def test_peaks_first_maximum(spark):
    assert last_ctx(spark, [1, 2, 3, 4])["peak_crowd"] is None      # n < 5
    r = last_ctx(spark, [1, 9, 2, 9, 1])
    assert r["peak_crowd"] == 9.0
    assert r["peak_ts"] == ts(1)                                     # first of two maxima
    assert r["is_peak"] is True


def test_dominant_flow_tie_latest_first_appearance(spark):
    r = last_ctx(spark, [1, 1, 1, 1], flows=["north", "east", "north", "east"])
    assert r["ctx_flow_direction"] == "east"
    r = last_ctx(spark, [1, 1, 1], flows=["east", "north", "north"])
    assert r["ctx_flow_direction"] == "north"


def test_window_is_100_frames_and_30_seconds(spark):
    # 150 frames 0.1 s apart: the 100-row cap binds
    r = CX.recent_context(frames(spark, [1] * 150, step=0.1)).orderBy(F.col("frame_id").desc()).first()
    assert r["n_recent"] == 100
    # frames 10 s apart: only 4 of them are within 30 s (inclusive)
    r = CX.recent_context(frames(spark, [1] * 10, step=10.0)).orderBy(F.col("frame_id").desc()).first()
    assert r["n_recent"] == 4


def test_chunk_boundary_keeps_exact_window(spark):
    # frames straddling an hour boundary see the previous hour's tail
    base = [("bb", i, ts(3590 - 12 * 60 * 60 + i), 1, 0.5, "north", 1.0, 0.1, 0.1) for i in range(20)]
    df = spark.createDataFrame(base, SCHEMA)
    got = {r["frame_id"]: r["n_recent"] for r in CX.recent_context(df, chunk_s=3600).collect()}
    one = {r["frame_id"]: r["n_recent"] for r in CX.recent_context(df, chunk_s=10 ** 9).collect()}
    assert got == one


def test_baseline_has_no_midnight_wrap(spark):
    hist = spark.createDataFrame(
        [("bb", "immediate", ts(-12 * 3600 + 23 * 3600 - 7 * 86400), 4.0, 0.1, 1.0, 0.1, "north")],
        "billboard_id string, window_type string, ts timestamp, cluster_count double, avg_density double, "
        "dwell_avg double, engagement double, flow_direction string")
    # history at 23:xx one week earlier; a context row at 00:xx the next day-of-week is not the same weekday,
    # and a context row at 00:xx of the same weekday must not match hour 23
    ctx = spark.createDataFrame([("bb", 1, ts(-12 * 3600 + 0 * 3600 + 600)), ("bb", 2, ts(-12 * 3600 + 22 * 3600))],
                                "billboard_id string, frame_id bigint, ts timestamp")
    got = {r["frame_id"]: r["base_n"] for r in CX.historical_baseline(ctx, hist).collect()}
    assert got[1] is None
    assert got[2] == 1


def test_flow_mean_compat_vs_circular(spark):
    moves = spark.createDataFrame([(1, 350.0, 1.0, "towards_billboard"), (1, 10.0, 1.0, "away_from_billboard")],
                                  "frame_id long, direction double, speed double, trajectory string")
    assert GM.flow_analysis(moves).first()["dominant_direction"] == "south"
    assert GM.flow_analysis(moves, circular=True).first()["dominant_direction"] == "north"
