"""Sequential rules on many tasks: grid leaders, thinning, ordered streams and their late side."""

import math
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from footfall.operators import enrich as EN
from footfall.operators import geometry as GE
from footfall.sources import uploads as UP
from footfall.streaming import jobs as ST
from footfall.streaming import ordered as O
from util import ts

DETS = "frame_id long, o1 long, o2 long, o3 long, x double, y double, z double, confidence double"


def leaders(rows, eps):
    """Plain leader clustering: {(frame, o1): cluster_id}."""
    out, seeds = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        mine = seeds.setdefault(r[0], [])
        x, y = r[4], r[5]
        near = [i for i, (sx, sy) in enumerate(mine) if None not in (x, y, sx, sy) and math.hypot(sx - x, sy - y) < eps]
        out[r[0], r[1]] = near[0] if near else len(mine)
        if not near:
            mine.append((x, y))
    return out


def crowd(seed):
    rng = random.Random(seed)
    rows = []
    for frame, n, spread in ((1, 400, 8.0), (2, 300, 2.0), (3, 40, 5.0), (4, 1, 1.0), (5, 300, 0.3)):
        for i in rng.sample(range(10 * n), n):
            rows.append((frame, i, 0, 0, round(rng.uniform(-spread, spread), rng.choice([1, 6])), round(rng.uniform(-spread, spread), rng.choice([1, 6])), 0.0, 0.9))
    rows += [(1, 10_000 + i, 0, 0, 1.0, 1.0, 0.0, 0.9) for i in range(50)]  # one place many times
    rows += [(2, 20_000, 0, 0, None, 1.0, 0.0, 0.9), (2, 20_001, 0, 0, None, 1.0, 0.0, 0.9), (2, 20_002, 0, 0, float("nan"), 1.0, 0.0, 0.9), (2, 20_003, 0, 0, 1e300, 0.0, 0.0, 0.9)]
    return rows


def test_grid_leaders_equal_plain_and_fold(spark):
    rows = crowd(1)
    dets = spark.createDataFrame(rows, DETS).repartition(5)
    for eps in (1.5, 0.37):
        want = leaders([(*r[:4], None if r[4] != r[4] else r[4], *r[5:]) for r in rows], eps)
        for limit in (0, 50, 10_000):
            got = {(r.frame_id, r.o1): r.cluster_id for r in GE.cluster_detections(dets, eps, fold_detections=limit).collect()}
            assert got == want
    assert GE.grid_leaders(dets.limit(0)).count() == 0


def test_grid_rounds_make_few_rows(spark):
    """A frame with all detections in one cell: candidates stay one a round, whatever the cell holds."""
    rows = [(1, i, 0, 0, 0.5 + i * 1e-7, 0.5, 0.0, 0.9) for i in range(3000)]
    got = GE.grid_leaders(spark.createDataFrame(rows, DETS)).groupBy("cluster_id").count().collect()
    assert [(r[0], r[1]) for r in got] == [(0, 3000)]


def thinned(rows, metres, wait):
    out, last = [], {}
    rows = [r for r in rows if None not in r]
    for u, s, e, t, y, x in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        if (u, s) in last:
            t0, y0, x0 = last[u, s]
            a = math.sin(math.radians(y - y0) / 2) ** 2 + math.cos(math.radians(y0)) * math.cos(math.radians(y)) * math.sin(math.radians(x - x0) / 2) ** 2
            if 2 * EN.EARTH_R_M * math.asin(min(1.0, math.sqrt(a))) < metres or t - t0 < wait:
                continue
        last[u, s] = (t, y, x)
        out.append(e)
    return sorted(out)


@pytest.mark.parametrize("metres,wait", [(100.0, 0), (60.0, 40), (0.0, 25)])
def test_thinning_carries_the_last_kept_fix(spark, metres, wait):
    rng, rows = random.Random(3), []
    for i in range(3000):
        rows.append((f"u{min(rng.randrange(6), 2)}", f"s{rng.randrange(2)}", f"e{i:05d}", rng.randrange(20_000), 40 + rng.randrange(8) * 0.0004, -74 + rng.randrange(5) * 0.0005))
    rows += [("u1", "s1", "n1", None, 40.0, -74.0), ("u1", "s1", "n2", 5, None, -74.0), ("u9", "s0", "n3", 5, 40.0, None)]
    fixes = spark.createDataFrame([(u, s, e, None if t is None else ts(t), y, x, {"k": e}) for u, s, e, t, y, x in rows],
                                  "uuid string, session_id string, event_id string, ts timestamp, lat double, lng double, context map<string,string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # so that state really crosses batches
    try:
        got = EN.thin_locations(fixes, metres, wait)
        assert got.columns == fixes.columns and sorted(r.event_id for r in got.collect()) == thinned(rows, metres, wait)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert EN.thin_locations(fixes.limit(0)).count() == 0


# ------------------------------------------------------------------ streams
def feed(spark, path, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.05)


def drain(spark, path, schema, build):
    s = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    build(s).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_late_marks_count_and_later_ones_come_out(spark, tmp_path):
    """A content_start that comes late takes effect; what comes behind the watermark is put out, none is lost."""
    schema = "device_id string, event_id long, ts timestamp, event_type string, content_id string"
    b1 = [("d", 1, ts(0), "content_start", "a"), ("d", 2, ts(100), "interaction", None), ("e", 3, ts(50), "interaction", None)]
    b2 = [("d", 4, ts(60), "content_start", "b"), ("d", 5, ts(130), "interaction", None), ("e", 6, ts(400), "other", "x"), ("e", 7, ts(400), "interaction", None)]
    b3 = [("d", 8, ts(20), "interaction", None), ("d", 9, ts(20), "content_start", "z"), ("d", 10, ts(390), "interaction", None)]
    end = [("~", 11, ts(90_000), "interaction", None)]
    feed(spark, tmp_path, [b1, b2, b3, end], schema)
    out = drain(spark, tmp_path, schema, lambda s: ST.stream_current_content(s, "2 minutes", salts=1))
    rows = {r.event_id: (r.current_content, r.late) for r in out.collect()}
    assert rows == {"2": ("b", False), "5": ("b", False), "3": (None, False), "7": (None, False), "10": ("b", False),
                    "8": (None, True), "9": (None, True)}


def test_held_frames_leave_the_state(spark, tmp_path):
    """Hold, expire and clear; at the end the state holds nothing of the ended billboards."""
    schema = "billboard_id string, frame_id long, ts timestamp, mode string, is_mode boolean"
    b1 = [("b", 1, ts(0), "minimal", True), ("b", 2, ts(10), None, False), ("b", 3, ts(20), "balanced", True), ("b", 4, ts(30), None, False)]
    b2 = [("b", 5, ts(1000), "strict", True), ("b", 6, ts(1010), None, False), ("c", 7, ts(5), None, False)]
    feed(spark, tmp_path, [b1, b2, [("~", 9, ts(90_000), "strict", True)]], schema)

    def build(s):
        frames = s.where(~F.col("is_mode"))
        modes = s.where("is_mode").select("billboard_id", "ts", "mode", "frame_id")
        return ST.stream_retention(frames, modes, "1 minute", salts=1)

    out = [(r.billboard_id, r.frame_id, r.mode, r.action, (r.at_us - 1704110400000000) // 1_000_000) for r in drain(spark, tmp_path, schema, build).collect()]
    assert sorted(out) == sorted([("b", 2, "minimal", "hold", 10), ("b", 4, "balanced", "hold", 30), ("b", 2, "minimal", "clear", 1000),
                                  ("b", 4, "balanced", "clear", 1000), ("b", 6, "strict", "hold", 1010), ("b", 6, "strict", "expire", 1310)]
                                 + [x for x in out if x[0] == "c"])
    assert all(x[3] is None or x[3] in ("hold", "expire") for x in out if x[0] == "c")
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/ck")
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/ck")
    held = [r[0] for r in state.select(F.get_json_object("value.value", "$.held")).collect()]
    assert set(held) <= {"[]"} and waiting.where("key.key <> '~'").count() == 0


def test_on_time_and_late_are_all_rows(spark):
    rows = [(i, ts(i), ts(i + d)) for i, d in enumerate((0, 3600, 3601, -5, 10_000))] + [(9, ts(0), None)]
    df = spark.createDataFrame(rows, "i int, ts timestamp, ingest_ts timestamp")
    assert sorted(r.i for r in ST.on_time(df, "1 hour").collect()) == [0, 1, 3, 9]
    assert sorted(r.i for r in ST.late_rows(df, "1 hour").collect()) == [2, 4]


def test_rejects_are_kept_and_a_replay_writes_the_same(spark, tmp_path):
    lines = ['{"client_id":"c","events":[{"event_id":"e1"},{"event_id":"e2"}]}', "{cut", '{"client_id":"x"}', ""]
    batch = spark.createDataFrame([(x,) for x in lines], "value string").withColumn("received_at", F.lit(ts(7)))
    route = UP.route_uploads(str(tmp_path / "events"), str(tmp_path / "rejects"))
    for _ in range(2):
        route(batch, 3)
    events, rejects = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "rejects"))
    assert sorted((r.event_id, r.client_id, r.received_at) for r in events.collect()) == [("e1", "c", ts(7)), ("e2", "c", ts(7))]
    assert sorted(r[0] for r in rejects.select(UP.CORRUPT).collect()) == ["", '{"client_id":"x"}', "{cut"]
