"""Crowd geometry per sensor frame.

Inputs are long tables keyed by frame (points, detections, poses,
movements) so that filters reach the parquet scan and every aggregate is a
partial + final hash aggregate on the frame key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.jsmath import js_round, safe_div, truthy_num
from footfall.functions.timeparts import hour_of_us, dow0_of_us, local_us, time_of_day
from footfall.operators.asof import prev_row
from footfall.session import materialize
from footfall.sources import lookups as L

# Cardinal directions, index = floor(((deg + 22.5) mod 360) / 45)
CARDINALS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]
EPS = 1.5  # clustering radius (m)


def validate_frames(points: DataFrame, frame: str = "frame_id", order: tuple[str, ...] = ("o1", "o2", "o3"),
                    frames: DataFrame | None = None) -> DataFrame:
    """L1: (frame, valid).  A frame is invalid when it has no points or its
    first point has x, y or z null or 0 (JS falsy).  ``frames`` lists all
    frame keys (frames absent from ``points`` have no points); by default
    only frames present in ``points`` are judged."""
    first = points.groupBy(frame).agg(
        F.min_by(F.struct("x", "y", "z"), F.struct(*order)).alias("p"))
    ok = truthy_num(F.col("p.x")).isNotNull() & truthy_num(F.col("p.y")).isNotNull() \
        & truthy_num(F.col("p.z")).isNotNull()
    judged = first.select(frame, ok.alias("valid"))
    if frames is None:
        return judged
    return frames.select(frame).distinct().join(judged, frame, "left") \
        .select(frame, F.coalesce(F.col("valid"), F.lit(False)).alias("valid"))


def valid_points(points: DataFrame, frame: str = "frame_id", order: tuple[str, ...] = ("o1", "o2", "o3")) -> DataFrame:
    """Points of valid frames only (left semi join on the frame key)."""
    ok = validate_frames(points, frame, order).where("valid").select(frame)
    return points.join(ok, frame, "left_semi")


def filter_points(points: DataFrame, max_range: float | Column = L.DEFAULT_MAX_RANGE,
                  fov: float | Column = L.DEFAULT_FOV) -> DataFrame:
    """L2: keep 0.5 <= |p| <= max_range and |atan2(y, x)| <= fov / 2.

    With literal limits, the redundant bounds ``x > 0`` (|angle| <= 90°
    needs x >= 0) and ``|x|, |y|, |z| <= max_range`` are added: they are
    plain comparisons, so parquet can skip row groups with them."""
    dist = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    ang = F.abs(F.degrees(F.atan2(F.col("y"), F.col("x"))))
    mr = max_range if isinstance(max_range, Column) else F.lit(float(max_range))
    fv = fov if isinstance(fov, Column) else F.lit(float(fov))
    out = points
    if not isinstance(max_range, Column):
        r = float(max_range)
        out = out.where(F.col("x").between(-r, r) & F.col("y").between(-r, r) & F.col("z").between(-r, r))
        if not isinstance(fov, Column) and float(fov) / 2 < 90:
            out = out.where(F.col("x") >= 0)
    return out.where((dist >= 0.5) & (dist <= mr) & (ang <= fv / 2))


def frame_stats(points: DataFrame, frame: str = "frame_id", order: tuple[str, ...] = ("o1", "o2", "o3"),
                max_range: float = L.DEFAULT_MAX_RANGE, fov: float = L.DEFAULT_FOV) -> DataFrame:
    """L3: per frame: raw points, accepted flag, points kept after the
    range / field-of-view filter (0 for dropped frames)."""
    valid = validate_frames(points, frame, order)
    raw = points.groupBy(frame).agg(F.count(F.lit(1)).alias("raw_points"))
    kept = filter_points(points, max_range, fov).groupBy(frame).agg(F.count(F.lit(1)).alias("kept"))
    return raw.join(valid, frame).join(kept, frame, "left").select(
        frame, "raw_points", F.col("valid").alias("accepted"),
        F.when(F.col("valid"), F.coalesce(F.col("kept"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
        .alias("kept_points"))


#: Detections of a frame up to which it is folded as one list; larger frames go by grid rounds.  Both give the same rows.
FOLD_DETECTIONS = 256


def cluster_detections(dets: DataFrame, eps: float = EPS, frame: str = "frame_id",
                       order: tuple[str, ...] = ("o1", "o2", "o3"), fold_detections: int = FOLD_DETECTIONS) -> DataFrame:
    """L4: leader clustering per frame (the reference's "dbscan" is this):
    in detection order, a detection joins the first existing seed whose XY
    distance is strictly below ``eps``, else it becomes a new seed.  Adds
    ``cluster_id`` (0-based, in seed order).

    A detection without a position (null, NaN, or 10^15 m and more away) is a seed that nothing joins; equal
    order values go by the other columns.  Frames of up to
    ``fold_detections`` are folded as a bounded list; a frame of any size
    beyond is spread over tasks by :func:`grid_leaders`."""
    sizes = dets.groupBy(frame).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_detections)
    large = materialize(sizes.select(frame), "large-frames")
    if large.isEmpty():
        return _folded_leaders(dets, eps, frame, order)
    small = _folded_leaders(dets.join(large, frame, "left_anti"), eps, frame, order)
    return small.unionByName(grid_leaders(dets.join(large, frame, "left_semi"), eps, frame, order))


def _folded_leaders(dets: DataFrame, eps: float, frame: str, order: tuple[str, ...]) -> DataFrame:
    """Leader clustering of frames of bounded size: a fold over each frame's sorted list."""
    cols = [*order, "x", "y", "z", "confidence"]
    arr = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in cols])))
    init = F.struct(
        F.array().cast("array<struct<x:double,y:double,id:int>>").alias("seeds"),
        F.array().cast("array<int>").alias("labels"),
    )
    e2 = F.lit(float(eps))

    def step(acc, d):
        near = F.filter(acc["seeds"], lambda s: F.sqrt((s["x"] - d["x"]) * (s["x"] - d["x"])
                                                       + (s["y"] - d["y"]) * (s["y"] - d["y"])) < e2)
        n = F.size(acc["seeds"])
        return F.when(F.size(near) > 0, F.struct(
            acc["seeds"].alias("seeds"),
            F.array_append(acc["labels"], near[0]["id"]).alias("labels"),
        )).otherwise(F.struct(
            F.array_append(acc["seeds"], F.struct(d["x"].cast("double").alias("x"), d["y"].cast("double").alias("y"),
                                                  n.alias("id"))).alias("seeds"),
            F.array_append(acc["labels"], n).alias("labels"),
        ))

    g = dets.groupBy(frame).agg(arr.alias("d"))
    g = g.select(frame, "d", F.aggregate("d", init, step)["labels"].alias("labels"))
    z = g.select(frame, F.inline(F.arrays_zip(F.col("d").alias("d"), F.col("labels").alias("cluster_id"))))
    return z.select(frame, *[F.col(f"d.{c}").alias(c) for c in cols], "cluster_id")


def grid_leaders(dets: DataFrame, eps: float = EPS, frame: str = "frame_id",
                 order: tuple[str, ...] = ("o1", "o2", "o3")) -> DataFrame:
    """Leader clustering by bulk-synchronous rounds over a spatial hash grid.

    The seeds are the greedy independent set of the detections in their
    order.  Cells are so small (eps / sqrt 2) that any two detections of a
    cell are near each other: only a cell's first undecided detection can be
    the next seed, and a cell has one seed at most.  Each round takes these
    firsts, drops those with an earlier undecided detection near them in
    the 5 x 5 cells around, makes the others seeds, and takes out what is near
    a new seed.  Every detection meets at most 25 firsts a round, so no
    round makes more than 25 rows per detection whatever a cell holds, and
    the joins are plain equi-joins on (frame, cell) that AQE can split.
    At least the first undecided detection of each frame is decided per round.

    At the end each detection takes the earliest seed near it that comes
    before it.  Seeds are eps apart, so the frame-wise numbering of the seeds
    is bounded by the sensor's range."""
    cols = [*order, "x", "y", "z", "confidence"]
    side = F.lit(eps / math.sqrt(2.0) * (1.0 - 1e-9))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    rows = dets.select(frame, *cols).withColumn("_no", F.monotonically_increasing_id())
    rows = materialize(rows, "grid").withColumn("_o", F.struct(*cols, "_no"))
    far = F.lit(9e15) * side
    placed = F.coalesce((F.abs(x) < far) & (F.abs(y) < far), F.lit(False))
    at = rows.where(placed).select(frame, F.floor(x / side).alias("_cx"), F.floor(y / side).alias("_cy"),
                                   x.alias("_x"), y.alias("_y"), "_o", "_no")
    cell = [frame, "_cx", "_cy"]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])

    def around(firsts):
        """Each first detection (or seed) in its own cell and the 24 around."""
        s = firsts.select(frame, "_cx", "_cy", F.col("_x").alias("_sx"), F.col("_y").alias("_sy"), F.col("_o").alias("_so"),
                          F.explode(steps).alias("_s"))
        return s.select(frame, (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"),
                        "_sx", "_sy", "_so")

    dx, dy = F.col("_sx") - F.col("_x"), F.col("_sy") - F.col("_y")
    near = F.sqrt(dx * dx + dy * dy) < F.lit(float(eps))
    left, seeds = at, None
    while True:
        firsts = left.groupBy(*cell).agg(F.min(F.struct("_o", "_x", "_y")).alias("_f")).select(*cell, "_f.*")
        firsts = materialize(firsts, "grid-firsts")
        if firsts.isEmpty():
            break
        blocked = around(firsts).join(left, cell).where(near & (F.col("_o") < F.col("_so"))) \
            .select(F.col("_so._no").alias("_bno")).distinct()
        new = materialize(firsts.join(blocked, F.col("_o._no") == F.col("_bno"), "left_anti"), "grid-seeds")
        seeds = new if seeds is None else seeds.unionByName(new)
        out = around(new).join(left, cell).where(near).select("_no").distinct()
        left = materialize(left.join(out, "_no", "left_anti"), "grid-left")
    lone = rows.where(~placed).select(frame, F.col("_o").alias("_so"))
    named = lone if seeds is None else lone.unionByName(seeds.select(frame, F.col("_o").alias("_so")))
    named = named.withColumn("cluster_id", (F.row_number().over(Window.partitionBy(frame).orderBy("_so")) - 1).cast("int"))
    own = named.select(F.col("_so._no").alias("_no"), F.col("_so._no").alias("_sno"))
    if seeds is not None:
        first = around(seeds).join(at, cell).where(near & (F.col("_so") <= F.col("_o"))).groupBy("_no").agg(F.min("_so").alias("_so"))
        own = first.select("_no", F.col("_so._no").alias("_sno")).unionByName(
            lone.select(F.col("_so._no").alias("_no"), F.col("_so._no").alias("_sno")))
    ids = named.select(F.col("_so._no").alias("_sno"), "cluster_id")
    return rows.join(own, "_no").join(ids, "_sno").select(frame, *cols, "cluster_id")


def cluster_stats(clustered: DataFrame, eps: float = EPS, frame: str = "frame_id") -> DataFrame:
    """Size, centroid (mean x, y, z) and density = size / (π eps²)."""
    area = math.pi * eps * eps
    return clustered.groupBy(frame, "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
    ).withColumn("density", F.col("size") / F.lit(area))


def frame_confidence(dets: DataFrame, stats: DataFrame, frame: str = "frame_id") -> DataFrame:
    """0.7 · avg(confidence) + 0.3 · min(avg cluster density, 1); 0 for
    a frame without detections (absent frames are left to the caller)."""
    d = dets.groupBy(frame).agg(F.avg("confidence").alias("avg_conf"))
    c = stats.groupBy(frame).agg(F.avg("density").alias("avg_density"))
    return d.join(c, frame, "left").select(
        frame, (F.col("avg_conf") * 0.7 + F.least(F.coalesce("avg_density", F.lit(0.0)), F.lit(1.0)) * 0.3)
        .alias("confidence"))


def engagement_metrics(poses: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Attention rate (share looking at the billboard), average
    engagement, and counts high (> 0.7), medium (0.4, 0.7], low (<= 0.4).
    Frames without poses have no row (NULL metrics)."""
    s = F.col("engagement_score")
    return poses.groupBy(frame).agg(
        (F.count_if(F.col("estimated_attention") == "billboard") / F.count(F.lit(1))).alias("attention_rate"),
        F.avg(s).alias("average_engagement"),
        F.count_if(s > 0.7).alias("high"),
        F.count_if((s > 0.4) & (s <= 0.7)).alias("medium"),
        F.count_if(s <= 0.4).alias("low"),
    )


def cardinal(deg: Column) -> Column:
    """Direction name for degrees: index floor(((deg + 22.5) mod 360) / 45)
    (JS ``%`` keeps the sign of the dividend, like ``fmod``)."""
    idx = F.floor(((deg + F.lit(22.5)) % F.lit(360.0)) / F.lit(45.0)).cast("int")
    return F.when(idx >= 0, F.element_at(F.array(*[F.lit(c) for c in CARDINALS]), idx + 1))


def flow_analysis(moves: DataFrame, frame: str = "frame_id", circular: bool = False) -> DataFrame:
    """Dominant direction from the mean heading, mean speed, intensity
    n/10, towards/away counts.

    ``circular=False`` (compat default) takes the arithmetic mean of the
    degrees, which is wrong near north (350° and 10° average to 180°);
    ``circular=True`` uses atan2(Σ sin, Σ cos), rounded to 1e-9°."""
    rad = F.radians("direction")
    agg = moves.groupBy(frame).agg(
        F.avg("direction").alias("mean_deg"),
        F.sum(F.sin(rad)).alias("ssin"), F.sum(F.cos(rad)).alias("scos"),
        F.avg("speed").alias("average_speed"),
        (F.count(F.lit(1)) / F.lit(10.0)).alias("flow_intensity"),
        F.count_if(F.col("trajectory") == "towards_billboard").alias("towards"),
        F.count_if(F.col("trajectory") == "away_from_billboard").alias("away"),
    )
    # rounded to 1e-9 degrees so that a mean lying on a sector edge bins the
    # same way whatever libm computed the last bit of atan2
    circ = F.round(F.pmod(F.degrees(F.atan2("ssin", "scos")), F.lit(360.0)), 9)
    avg_dir = circ if circular else F.col("mean_deg")
    return agg.select(frame, avg_dir.alias("avg_direction"), cardinal(avg_dir).alias("dominant_direction"),
                      "average_speed", "flow_intensity", "towards", "away")


def movements_from_tracks(tracks: DataFrame, track: str = "track_id", order: tuple[str, ...] = ("ts",),
                          dt_s: Column | None = None, bucket_us: int = 3_600_000_000) -> DataFrame:
    """L9 (ours): heading (0° = +y, clockwise), speed and trajectory from
    consecutive positions of one track; the sensor sits at the origin, so a
    shrinking distance means towards the billboard.  First position of a
    track has no movement.

    The position before comes from ``prev_row``, which cuts a track into
    time buckets, so a track of very many positions is spread over tasks.
    A track without a time column (``order`` of plain numbers) is cut by its
    first order column in steps of ``bucket_us``."""
    cut = order[0] if order[0] == "ts" else "_cut"
    rows = tracks if cut == "ts" else tracks.withColumn("_cut", F.timestamp_micros(F.col(order[0]).cast("bigint")))
    rows = rows.withColumn("_before", F.struct("x", "y", F.col(cut).alias("t")))
    out = prev_row(rows, track, cut, list(order), ["_before"], bucket_us).where(F.col("prev__before.x").isNotNull())
    px, py = F.col("prev__before.x"), F.col("prev__before.y")
    dx, dy = F.col("x") - px, F.col("y") - py
    dt = dt_s if dt_s is not None else (F.unix_micros(cut) - F.unix_micros("prev__before.t")) / F.lit(1e6)
    d_now = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    d_prev = F.sqrt(px * px + py * py)
    return out.withColumn("direction", F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))) \
        .withColumn("speed", safe_div(F.sqrt(dx * dx + dy * dy), dt)) \
        .withColumn("trajectory", F.when(d_now < d_prev, "towards_billboard").otherwise("away_from_billboard")) \
        .drop("_before", "prev__before", "_cut")


def age_distribution(counts: DataFrame, frame: str = "frame_id", bucket: str = "bucket",
                     value: str = "share") -> DataFrame:
    """Each bucket = JS-round(100 · value / Σ values of the frame); no
    repair to 100.  A window sum over one frame's handful of buckets."""
    total = F.sum(value).over(Window.partitionBy(frame))
    return counts.withColumn("pct", js_round(F.lit(100.0) * F.col(value) / total))


def frame_metrics(clustered: DataFrame, flow: DataFrame, engagement: DataFrame, frame: str = "frame_id",
                  eps: float = EPS) -> DataFrame:
    """One row per frame with detections: clusterCount, totalPeople,
    avgDensity (0 if none), dwellAvg = avg(min(size·density·30, 300)),
    dwellMax = max(min(size·density·45, 600)), flow (``unknown``/0 when
    absent), engagement / attention (0 when no poses), confidence (L6).

    ``clustered``: the detections with their ``cluster_id`` (L4).  Clusters,
    people and confidence come from one pass over it, grouped by cluster and
    then by frame; it is dealt by frame already, so neither that nor the joins
    add an exchange for it."""
    size, density = F.col("size"), F.col("density")
    per = clustered.groupBy(frame, "cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sum("confidence").alias("conf")) \
        .withColumn("density", size / F.lit(math.pi * eps * eps))
    cl = per.groupBy(frame).agg(
        F.count(F.lit(1)).alias("cluster_count"),
        F.sum(size).alias("total_people"),
        (F.sum("conf") / F.sum(size)).alias("avg_conf"),
        F.avg(density).alias("avg_density"),
        F.avg(F.least(size * density * 30, F.lit(300.0))).alias("dwell_avg"),
        F.max(F.least(size * density * 45, F.lit(600.0))).alias("dwell_max"),
    ).withColumn("confidence", F.col("avg_conf") * 0.7 + F.least(F.coalesce("avg_density", F.lit(0.0)), F.lit(1.0)) * 0.3)
    out = cl.join(flow, frame, "left").join(engagement, frame, "left")
    return out.select(
        frame,
        F.coalesce("cluster_count", F.lit(0)).cast("bigint").alias("cluster_count"),
        "total_people",
        F.coalesce("avg_density", F.lit(0.0)).alias("avg_density"),
        F.coalesce("dominant_direction", F.lit("unknown")).alias("flow_direction"),
        F.coalesce(truthy_num(F.col("flow_intensity")), F.lit(0.0)).alias("flow_intensity"),
        F.coalesce(truthy_num(F.col("average_speed")), F.lit(0.0)).alias("average_speed"),
        F.coalesce("dwell_avg", F.lit(0.0)).alias("dwell_avg"),
        F.coalesce("dwell_max", F.lit(0.0)).alias("dwell_max"),
        F.coalesce(truthy_num(F.col("average_engagement")), F.lit(0.0)).alias("engagement"),
        F.coalesce(truthy_num(F.col("attention_rate")), F.lit(0.0)).alias("attention"),
        F.coalesce(truthy_num(F.col("confidence")), F.lit(0.0)).alias("confidence"),
    )


def frame_time_context(df: DataFrame, us_col: str = "ts_us", tz: str | None = None) -> DataFrame:
    """Time of day (local zone), day of week 0 = Sunday, hour, and
    lighting (daylight iff 6 <= hour < 20)."""
    loc = local_us(F.col(us_col), tz)
    h = hour_of_us(loc)
    return df.withColumn("hour", h).withColumn("day_of_week", dow0_of_us(loc)) \
        .withColumn("time_of_day", time_of_day(h)) \
        .withColumn("lighting", F.when((h >= 6) & (h < 20), "daylight").otherwise("artificial"))


def frame_rate(frames: DataFrame, key: str = "billboard_id", ts: str = "ts",
               order: tuple[str, ...] = ("ts", "frame_id")) -> DataFrame:
    """1000 / Δt(ms) between consecutive frames of a sensor; NULL for
    the first frame and for Δt = 0.

    The lag is taken inside (sensor, hour) partitions; the first frame of an
    hour gets the previous hour's last frame time from a per-hour summary,
    so a sensor with a large share of frames is still split by hour."""
    hour = F.floor(F.unix_micros(F.col(ts)) / F.lit(3_600_000_000)).cast("bigint")
    b = frames.withColumn("_h", hour)
    last_per_hour = b.groupBy(key, "_h").agg(F.max(F.struct(*order)).alias("_last"))
    wk = Window.partitionBy(key).orderBy("_h")
    carry = last_per_hour.select(key, "_h", F.lag("_last").over(wk).alias("_prev_last"))
    w = Window.partitionBy(key, "_h").orderBy(*order)
    j = b.join(carry, [key, "_h"], "left")
    prev = F.coalesce(F.lag(F.col(ts)).over(w), F.col("_prev_last")[ts])
    dt_ms = (F.unix_micros(F.col(ts)) - F.unix_micros(prev)) / F.lit(1000.0)
    return j.withColumn("frame_rate", safe_div(F.lit(1000.0), dt_ms)).drop("_h", "_prev_last")
