"""Steps that must not grow into one task, one group or one list per row."""

import os

from pyspark.sql import functions as F

from footfall.operators import context as CX
from footfall.plans import streams as S
from footfall.streaming import jobs as ST
from test_order import drain, feed
from util import ts

FRAMES = "billboard_id string, frame_id long, ts timestamp, cluster_count long, avg_density double, flow_direction string, dwell_avg double, engagement double, attention double"


def frame_rows(n, step):
    return [("b" if i % 5 else "c", i, ts(i * step), i * 7 % 20, i % 11 / 10, ("north", "east", None, "up")[i * 3 % 4], i % 13 * 1.5, i % 10 / 10, i % 7 / 7) for i in range(n)]


def test_context_takes_no_list_per_row_and_cuts_a_busy_hour(spark):
    rows = frame_rows(1500, 0.4)
    got = CX.recent_context(spark.createDataFrame(rows, FRAMES))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "RangeFrame, -" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)  # so that windows reach back over batches
    try:
        small = {r.frame_id: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = {r.frame_id: r for r in CX.recent_context(spark.createDataFrame(rows, FRAMES), chunk_s=10**6).collect()}
    assert small == one and len(one) == 1500 and max(r.n_recent for r in one.values()) < 100


def test_frames_without_a_time_are_one_window(spark):
    rows = [(*r[:2], None, *r[3:]) for r in frame_rows(10, 1)] + frame_rows(3, 1)
    got = CX.recent_context(spark.createDataFrame(rows, FRAMES)).where("ts is null").collect()
    assert sorted((r.billboard_id, r.n_recent) for r in got) == [("b", 8)] * 8 + [("c", 2)] * 2


def test_slices_are_written_by_all_tasks(spark):
    df = spark.range(4000).select("id", F.timestamp_seconds(F.col("id") + 1_704_067_200).alias("ts")).repartition(4)
    out = S.run_incremental(spark, "slices", df, lambda s: s)
    assert spark.read.parquet(out).count() == 4000 and spark.read.parquet(out).distinct().count() == 4000
    files = [f for f in os.listdir(os.path.dirname(out) + "/in-a") if f.endswith(".parquet")]
    assert len(files) > 4  # one file a slice was one task's work


def test_small_keys_share_groups(spark, tmp_path):
    schema = "device_id string, event_id long, ts timestamp, event_type string, content_id string"
    rows = [(f"d{i}", 10 * i + k, ts(10 * k), *(("content_start", f"c{i}"), ("interaction", None))[k]) for i in range(200) for k in (0, 1)]
    rows += [(None, 5000, ts(0), "content_start", "n"), (None, 5001, ts(5), "interaction", None)]
    feed(spark, tmp_path, [rows, [("~", 9999, ts(90_000), "content_end", None)]], schema)
    got = drain(spark, tmp_path, schema, lambda s: ST.stream_current_content(s, "2 minutes", salts=1)).collect()
    assert {(r.event_id, r.current_content) for r in got} == {(str(10 * i + 1), f"c{i}") for i in range(200)} | {("5001", "n")}
    groups = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/ck").count()
    assert groups <= ST.BUCKETS


def test_a_billboards_time_is_dealt_over_groups(spark, tmp_path):
    """Figures per frame as in batch, from several groups, and none waits as a list per frame."""
    rows = frame_rows(1500, 0.4)
    end = ("~", 9999, ts(90_000), 1, 1.0, "north", 1.0, 1.0, 1.0)
    feed(spark, tmp_path, [rows[:700], rows[700:], [end]], FRAMES)
    got = drain(spark, tmp_path, FRAMES, lambda s: ST.stream_recent_context(s, "1 minute"))
    names = ["frame_id", *[c for c in CX.CONTEXT_COLUMNS if c != "peak_ts"]]
    want = CX.recent_context(spark.createDataFrame(rows, FRAMES)).select(names)
    # a direction that the sensors don't name is its own on the stream
    skip = ("ctx_flow_direction", "stability")
    cols = [c for c in names if c not in skip]
    assert sorted(map(tuple, got.where("frame_id < 9999").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/ck")
    assert state.where("key.key = 'b'").select("key.salt").distinct().count() > 1


def test_trailing_weights_of_many_users(spark, tmp_path):
    schema = "event_id string, uuid string, ts timestamp, event_type string"
    rows = [(f"{u}-{k}", f"u{u}", ts(100 * k), "add_to_cart") for u in range(100) for k in range(4)]
    feed(spark, tmp_path, [rows, [("end", "~", ts(900_000), "add_to_cart")]], schema)
    got = drain(spark, tmp_path, schema, lambda s: ST.stream_intent_trigger(s, 3.0, 7, "1 hour")).collect()
    assert sorted((r.event_id, r.uuid, r.trailing_weight) for r in got) == sorted((f"{u}-2", f"u{u}", 3.0) for u in range(100))
