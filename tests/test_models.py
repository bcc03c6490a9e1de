"""Plain-Python models of the sequential rules, compared with the Spark
plans on random inputs: leader clustering, the half-step EWMA, the
100-frame / 30-second window and the dominant-flow tie rule."""

import math
import random

from pyspark.sql import functions as F

from footfall.operators import context as CX
from footfall.operators import geometry as GM
from footfall.operators import sessions as SS
from tests.util import ts


def leader_clusters(points, eps=1.5):
    seeds, labels = [], []
    for x, y in points:
        hit = next((i for i, (sx, sy) in enumerate(seeds) if math.sqrt((sx - x) ** 2 + (sy - y) ** 2) < eps), None)
        if hit is None:
            seeds.append((x, y))
            hit = len(seeds) - 1
        labels.append(hit)
    return labels


def test_leader_clustering_matches_model(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for f in range(40):
        pts = [(round(rnd.uniform(-4, 4), 2), round(rnd.uniform(-4, 4), 2)) for _ in range(rnd.randint(1, 12))]
        for i, (x, y) in enumerate(pts):
            rows.append((f, i, 0, 0, x, y, 1.0, 0.9))
        for i, lab in enumerate(leader_clusters(pts)):
            expect[(f, i)] = lab
    df = spark.createDataFrame(rows, "frame_id long, o1 int, o2 long, o3 long, x double, y double, z double, "
                                     "confidence double")
    got = {(r["frame_id"], r["o1"]): r["cluster_id"] for r in GM.cluster_detections(df).collect()}
    assert got == expect


def test_half_ewma_matches_fold(spark):
    rnd = random.Random(3)
    vals = [rnd.uniform(0, 100) for _ in range(150)]
    df = spark.createDataFrame([("k", i, ts(i), v) for i, v in enumerate(vals)], "key string, i long, ts timestamp, v double")
    got = {r["i"]: r["half_ewma"] for r in SS.half_ewma(df, "key", ["ts", "i"], "v").collect()}
    a = 0.0
    for i, v in enumerate(vals):
        a = (a + v) / 2
        assert abs(got[i] - a) <= 1e-9 * max(1.0, abs(a))
    last = SS.last_half_ewma(df, "key", ["ts", "i"], "v").first()["half_ewma"]
    assert abs(last - a) <= 1e-9 * max(1.0, abs(a))


def model_context(frames):
    out = {}
    for idx, (fid, t, cc, fl) in enumerate(frames):
        win = [f for f in frames[max(0, idx - 99): idx + 1] if f[1] >= t - 30]
        dirs = [f[3] for f in win]
        counts, first = {}, {}
        for i, d in enumerate(dirs):
            counts[d] = counts.get(d, 0) + 1
            first.setdefault(d, i)
        best = None
        for d in first:
            if best is None or counts[d] >= counts[best]:
                best = d
        out[fid] = (len(win), math.floor(sum(f[2] for f in win) / len(win) + 0.5), best)
    return out


def test_recent_window_matches_model(spark):
    rnd = random.Random(11)
    t, frames = 0.0, []
    for i in range(400):
        t += rnd.choice([0.05, 0.1, 0.1, 0.2, 2.0, 35.0])
        frames.append((i, round(t, 3), rnd.randint(0, 15), rnd.choice(["north", "east", "south"])))
    rows = [("bb", fid, ts(tt), cc, 0.5, fl, 1.0, 0.5, 0.5) for fid, tt, cc, fl in frames]
    df = spark.createDataFrame(rows, "billboard_id string, frame_id bigint, ts timestamp, cluster_count bigint, "
                                     "avg_density double, flow_direction string, dwell_avg double, engagement double, "
                                     "attention double")
    got = {r["frame_id"]: (r["n_recent"], r["ctx_cluster_count"], r["ctx_flow_direction"])
           for r in CX.recent_context(df, chunk_s=60).collect()}
    assert got == model_context(frames)


def test_context_by_frames_equals_context_by_lists(spark):
    """Bursts, gaps, equal times, nulls, repeated rows and a window size that is odd: every column is the same from
    window aggregates as from the collected list."""
    rnd = random.Random(29)
    rows, t = [], 0.0
    for i in range(900):
        t += rnd.choice([0.0, 0.0, 0.000001, 0.3, 1.0, 29.999999, 30.0] if i % 450 < 120 else [0.0, 0.01, 0.1])
        null = rnd.random() < 0.1
        rows.append((rnd.choice(["a", "b"]), i, ts(round(t, 6)), None if null else rnd.randint(0, 9),
                     rnd.choice([None, 0.0, 0.25, 0.5]), rnd.choice([None, "unknown", "north", "east"]),
                     1.0, None if null else 0.5, 0.25))
    df = spark.createDataFrame(rows, "billboard_id string, frame_id bigint, ts timestamp, cluster_count bigint, "
                                     "avg_density double, flow_direction string, dwell_avg double, engagement double, "
                                     "attention double")
    for size, chunk in ((100, 3600), (7, 60), (2, 60)):
        frames = CX.recent_context(df, max_frames=size, chunk_s=chunk)
        lists = CX.aggregate_context(CX.recent_frames(df, max_frames=size, chunk_s=chunk)).select(frames.columns)
        by_id = {r["frame_id"]: r for r in lists.collect()}
        got = frames.collect()
        assert len(got) == len(by_id) == 900
        assert {r["n_recent"] == size for r in got} == {True, False}
        for r in got:
            for name, a, b in zip(frames.columns, r, by_id[r["frame_id"]]):
                assert a == b or isinstance(a, float) and math.isclose(a, b, abs_tol=1e-9), (size, r["frame_id"], name, a, b)
    assert CX.recent_context(df.limit(0)).count() == 0


def test_chunked_range_equals_global_window(spark):
    from pyspark.sql.window import Window

    from footfall.operators.asof import chunked_range
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(300):
        t += rnd.choice([0.5, 1.0, 3.0, 9.0])
        rows.append((rnd.choice(["a", "b"]), i, ts(t), float(rnd.randint(0, 9))))
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp, v double")
    horizon = 10_000_000
    got = {r["i"]: r["s"] for r in chunked_range(df, "k", "ts", horizon, 25_000_000,
                                                  {"s": lambda w: F.sum("v").over(w)}).collect()}
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-horizon + 1, 0)
    want = {r["i"]: r["s"] for r in df.select("i", F.sum("v").over(w).alias("s")).collect()}
    assert got == want


def test_half_ewma_exact_across_row_chunks(spark):
    rnd = random.Random(9)
    vals = [rnd.uniform(0, 10) for _ in range(500)]
    df = spark.createDataFrame([("k", i, ts(i * 7.0), v) for i, v in enumerate(vals)],
                               "key string, i long, ts timestamp, v double")
    small = {r["i"]: r["half_ewma"] for r in SS.half_ewma(df, "key", ["ts", "i"], "v", chunk_rows=70).collect()}
    big = {r["i"]: r["half_ewma"] for r in SS.half_ewma(df, "key", ["ts", "i"], "v").collect()}
    assert small == big


def test_global_row_number_equals_whole_key_row_number(spark):
    from pyspark.sql.window import Window

    from footfall.operators.asof import global_row_number
    rnd = random.Random(13)
    rows = [(rnd.choice(["a", "b", "c"]), i, ts(rnd.uniform(0, 40000))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp")
    got = {r["i"]: r["_rn"] for r in global_row_number(df, "k", "ts", ["ts", "i"], bucket_us=3_600_000_000).collect()}
    w = Window.partitionBy("k").orderBy("ts", "i")
    want = {r["i"]: r["rn"] for r in df.select("i", F.row_number().over(w).alias("rn")).collect()}
    assert got == want
