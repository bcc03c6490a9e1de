"""Snapshots of a stream take only the frames that a tick's figures can reach."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from footfall.operators import context as CX
from footfall.streaming import jobs as ST
from footfall.streaming import ordered as O
from test_order import drain, feed
from test_scale import FRAMES
from util import ts

FLOWS = ("north", "east", None, "south")


def busy(n, end_s, seed, keys=("b", "c", None)):
    """Frames in no order, many to a tick, with ties in time."""
    rng = random.Random(seed)
    return [(rng.choice(keys), i, ts(rng.randrange(int(end_s * 10)) / 10), rng.choice([None, *range(20)]), rng.random(), rng.choice(FLOWS), rng.random(), None, 0.5)
            for i in range(n)]


def snapshots(spark, rows):
    """What the stream must say: key -> tick -> (frame, figures) of the tick's last frame, from the batch form."""
    ctx = CX.recent_context(spark.createDataFrame([r for r in rows if r[0]], FRAMES)).collect()
    last = {}
    for r in ctx:
        tick = (int(r.ts.timestamp() * 1e6) // 5_000_000 + 1) * 5_000_000
        if (r.billboard_id, tick) not in last or (r.ts, r.frame_id) > (last[r.billboard_id, tick].ts, last[r.billboard_id, tick].frame_id):
            last[r.billboard_id, tick] = r
    return {k: (r.frame_id, r.n_recent, r.ctx_cluster_count, round(r.ctx_avg_density, 9), r.ctx_flow_direction, r.crowd_trend, r.peak_crowd) for k, r in last.items()}


def shown(out):
    return {(r.billboard_id, r.tick_us): (r.frame_id, r.n_recent, r.ctx_cluster_count, round(r.ctx_avg_density, 9), r.ctx_flow_direction, r.crowd_trend, r.peak_crowd)
            for r in out if not r.late and not r.repeated}


def test_crowded_ticks_are_thinned_before_the_shuffle(spark, tmp_path):
    """Figures as in batch, and of a tick no more than its last 100 frames wait one by one."""
    rows = busy(6000, 40, 1) + [("b", 6000 + i, ts(60 + i), 3, 0.5, "north", 1.0, 0.5, 0.5) for i in range(3)]
    end = ("~", 9999, ts(90_000), 1, 1.0, "north", 1.0, 1.0, 1.0)
    feed(spark, tmp_path, [rows[:3500], rows[3500:], [end]], FRAMES)
    got = drain(spark, tmp_path, FRAMES, lambda s: ST.stream_context_snapshot(s, 5, "1 minute")).where("billboard_id is null or billboard_id <> '~'").collect()
    assert shown([r for r in got if r.billboard_id]) == snapshots(spark, rows)
    assert not any(r.late for r in got) and {r.billboard_id for r in got} == {"b", "c", None}
    first = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 1).load(f"{tmp_path}/ck")
    held = sum(len(O.table_of(r[0])) for r in first.select("list_element.rows").collect())
    assert 0 < held <= 3 * (8 * 100 + 3) * 2  # three keys, eight ticks, two batches


def test_late_frames_of_a_crowded_tick_all_come_out(spark, tmp_path):
    """Frames behind the watermark come out marked, also those that no figure needs; figures take those in time."""
    early, late = busy(500, 5, 2, ("b",)), [(k, 1000 + i, *r) for i, (k, _, *r) in enumerate(busy(700, 10, 3, ("b",)))]
    mid = [("b", 900, ts(64), 1, 1.0, "north", 1.0, 1.0, 1.0)]  # the watermark is then within the late tick, at 4 s
    end = ("~", 9999, ts(90_000), 1, 1.0, "north", 1.0, 1.0, 1.0)
    feed(spark, tmp_path, [early, mid, late, [end]], FRAMES)
    got = drain(spark, tmp_path, FRAMES, lambda s: ST.stream_context_snapshot(s, 5, "1 minute")).where("billboard_id <> '~'").collect()
    behind = sorted(r[1] for r in late if r[2] < ts(4))
    assert sorted(r.frame_id for r in got if r.late) == behind and len(behind) > 200
    assert all(r.repeated is False and r.n_recent is None for r in got if r.late)
    assert shown(got) == snapshots(spark, early + mid + [r for r in late if r[2] >= ts(4)])


def test_newest_rows_of_a_tick_whatever_the_buffer(spark):
    """All rows come out once, kept or packed, and the last ones of each tick are kept."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(300)]), 1, f"{i:05d}" if i % 50 else None, {"x": float(i)}) for i in range(4000)]
    schema = pa.schema([("key", pa.string()), ("ts_us", pa.int64()), ("kind", pa.int32()), ("id", pa.string()), ("payload", pa.struct([("x", pa.float64())]))])
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    timed = [r for r in rows if r[1] is not None]
    want = set()
    for key in ("a", "b", None):
        for tick in range(3):
            mine = sorted((r for r in timed if r[0] == key and r[1] // 100 == tick), key=lambda r: (r[1], r[3] is None, r[3] or ""))
            want |= {r[4]["x"] for r in mine[-20:]}
    for limit in (150, 700, 10_000):
        out = pa.Table.from_batches([*O.thinned(20, 100, limit, piece=30)(iter(table.to_batches(max_chunksize=64)))]).to_pylist()
        plain, packed = [r for r in out if r["kind"] != O.SPARE], [r for r in out if r["kind"] == O.SPARE]
        assert want <= {r["payload"]["x"] for r in plain} and all(r["salt"] == 0 and r["spare"] is None for r in plain)
        spare = [(r["key"], t["ts_us"], t["id"]) for r in packed for t in O.table_of(r["spare"]).to_pylist()]
        assert sorted(map(str, spare + [(r["key"], r["ts_us"], r["id"]) for r in plain])) == sorted(str((r[0], r[1], r[3])) for r in timed)
        assert all(0 < r["salt"] <= O.SPARES and r["ts_us"] == O.table_of(r["spare"])["ts_us"][0].as_py() for r in packed)
        if limit == 10_000:
            assert {r["payload"]["x"] for r in plain} == want


def test_ticks_are_the_same_in_small_pieces():
    """Frames looked at a few at a time, over the border of a tick too."""
    rows = sorted((r for r in busy(900, 60, 5, ("b",))), key=lambda r: (r[2], r[1]))
    names, types = zip(*O.InOrder.COLUMNS)
    ripe = pa.table([pa.array(c, t) for c, t in zip(zip(*[(int(r[2].timestamp() * 1e6), 1, f"{r[1]:020d}", '{"cluster_count": %d}' % (r[3] or 0), "b") for r in rows]), types)], names=names)
    said = []
    for piece in (7, 50_000):
        ticks = O.Ticks(100, 30_000_000, 5_000_000, 60_000_000, piece)
        ticks.newest, ticks.schema, kept = O.Newest(100, 5_000_000, "name"), pa.schema(O.InOrder.COLUMNS), []
        ticks.recall, ticks.remember, ticks.wake = lambda d: d, kept.append, lambda t: None
        said.append(([x for out in ticks.released("b", ripe, 2**60) for x in out], kept))
    assert said[0] == said[1] and len(said[0][0]) > 12
