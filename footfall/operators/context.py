"""Rolling crowd context per billboard.

Frame metrics arrive as rows ``(billboard_id, frame_id, ts, cluster_count,
avg_density, flow_direction, dwell_avg, engagement, attention)``.

X1's window ("the last 100 frames that are at most 30 s old") is not a SQL
frame.  :func:`recent_context` takes the figures of each window in a pass over
sorted rows; only :func:`recent_frames`, whose result is the list itself,
collects one.  To keep a billboard with a large share of the frames from landing
in one task, time is cut into chunks (2 min, of lists 1 h) and the last 30 s of each chunk are copied into the next one as
read-only context: every frame then sees exactly the rows it would see in one
global window, and each (billboard, chunk) is its own window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType
from pyspark.sql.window import Window

from footfall.operators import trailing as TR
from footfall.functions.jsmath import js_round, q9, qsum9, safe_div
from footfall.session import materialize
from footfall.functions.timeparts import TOD_DENSITY, dow0_of_us, hour_of_us, local_us, time_of_day

METRICS = ("cluster_count", "avg_density", "flow_direction", "dwell_avg", "engagement", "attention")
SUMMED = ("cluster_count", "avg_density", "dwell_avg", "engagement", "attention")
CONTEXT_COLUMNS = ("n_recent", "ctx_cluster_count", "ctx_avg_density", "ctx_flow_direction", "ctx_dwell_avg", "ctx_engagement",
                   "ctx_attention", "crowd_trend", "density_trend", "engagement_trend", "stability", "peak_crowd", "peak_ratio",
                   "is_peak", "peak_ts")
DIRECTION_VALUES = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest", "unknown"]

# History window kinds (duration s, slide s)
# immediate 30 s every 5 s · short 5 min every 60 s · medium 30 min every 5 min · long 2 h every 30 min
WINDOW_KINDS = {"immediate": (30, 5), "short": (300, 60), "medium": (1800, 300), "long": (7200, 1800)}


def _z(c: Column) -> Column:
    """JS ``x || 0`` for a number."""
    return F.coalesce(F.when(~F.isnan(c.cast("double")) & (c != 0), c.cast("double")), F.lit(0.0))


# ------------------------------------------------------------------ X1
def _chunked(frames: DataFrame, ts: str, chunk_us: int, hz_us: int) -> DataFrame:
    """Frames with their time chunk, each chunk with a copy of the last ``hz_us`` of the one before (``_own`` false)."""
    us = F.unix_micros(F.col(ts))
    chunk = F.floor(us / F.lit(chunk_us)).cast("bigint")
    own = frames.withColumn("_chunk", chunk).withColumn("_own", F.lit(True))
    tail = frames.where(us - F.floor(us / F.lit(chunk_us)) * F.lit(chunk_us) >= F.lit(chunk_us - hz_us)) \
        .withColumn("_chunk", chunk + 1).withColumn("_own", F.lit(False))
    return own.unionByName(tail)


def recent_frames(frames: DataFrame, key: str = "billboard_id", ts: str = "ts", tie: str = "frame_id",
                  max_frames: int = 100, horizon_s: int = 30, chunk_s: int = 3600) -> DataFrame:
    """Adds ``recent`` = array of the frame's window (oldest first),
    each element ``struct(ts, cluster_count, avg_density, flow_direction,
    dwell_avg, engagement, attention)``."""
    chunk_us, hz_us = chunk_s * 1_000_000, horizon_s * 1_000_000
    w = Window.partitionBy(key, "_chunk").orderBy(ts, tie).rowsBetween(-(max_frames - 1), 0)
    hist = F.collect_list(F.struct(F.col(ts).alias("ts"), *[F.col(m) for m in METRICS])).over(w)
    cutoff = F.unix_micros(F.col(ts)) - F.lit(hz_us)
    return _chunked(frames, ts, chunk_us, hz_us) \
        .select("*", F.filter(hist, lambda h: F.unix_micros(h["ts"]) >= cutoff).alias("recent")) \
        .where("_own").drop("_own", "_chunk")


# ------------------------------------------------------------------ X2–X6
def _sums(arr: Column, fields: tuple[str, ...]) -> Column:
    """One left fold over the array giving a struct of the JS ``|| 0`` sums
    of several fields (one interpreted pass instead of one per field)."""
    init = F.struct(*[F.lit(0.0).alias(f) for f in fields])
    return F.aggregate(arr, init, lambda acc, x: F.struct(*[(acc[f] + _z(x[f])).alias(f) for f in fields]))


def _trend_of(n: Column, a1: Column, a2: Column) -> Column:
    return (
        F.when(n < 2, F.lit("stable"))
        .when(a1 == 0, F.when(a2 > 0, "increasing").when(a2 < 0, "decreasing").otherwise("stable"))
        .when((a2 - a1) / a1 > 0.1, "increasing")
        .when((a2 - a1) / a1 < -0.1, "decreasing")
        .otherwise("stable")
    )


_TRENDED = ("cluster_count", "avg_density", "engagement")
STATE = ("_n", "_s", "_h1", "_h2", "_ss", "_flow", "_flows", "_peak", "_peak_ts")


def context_of(df: DataFrame) -> DataFrame:
    """X2–X6 from the state of a frame's window: size ``_n``, sums ``_s``, sums of its older and newer half ``_h1`` and
    ``_h2``, summed squared deviations ``_ss``, dominant direction ``_flow``, number of directions ``_flows``, largest
    cluster count ``_peak`` and its first time ``_peak_ts``."""
    n = F.col("_n")
    half = F.floor(n / 2)
    mean_cc, mean_dn = F.col("_s.cluster_count") / n, F.col("_s.avg_density") / n

    def stab(mean, squares):
        coef = F.when(mean > 0, F.sqrt(squares / n) / mean).otherwise(F.lit(1.0))
        return F.greatest(F.lit(0.0), F.lit(1.0) - coef)

    stab_flow = F.lit(1.0) - (F.col("_flows") - 1) / F.greatest(n - 1, F.lit(1))
    overall = (stab(mean_cc, F.col("_ss.cc")) + stab(mean_dn, F.col("_ss.dn")) + stab_flow) / 3
    stability = (
        F.when(n < 3, F.lit("unknown")).when(overall > 0.8, "very_stable").when(overall > 0.6, "stable")
        .when(overall > 0.4, "moderate").when(overall > 0.2, "unstable").otherwise("very_unstable")
    )
    peak = F.col("_peak")

    def tr(f):
        return _trend_of(n, F.col(f"_h1.{f}") / half, F.col(f"_h2.{f}") / (n - half))

    return df.withColumns({
        "n_recent": n.cast("int"),
        "ctx_cluster_count": js_round(mean_cc),
        "ctx_avg_density": mean_dn,
        "ctx_flow_direction": F.coalesce(F.col("_flow"), F.lit("unknown")),
        "ctx_dwell_avg": F.col("_s.dwell_avg") / n,
        "ctx_engagement": F.col("_s.engagement") / n,
        "ctx_attention": F.col("_s.attention") / n,
        "crowd_trend": tr("cluster_count"),
        "density_trend": tr("avg_density"),
        "engagement_trend": tr("engagement"),
        "stability": stability,
        "peak_crowd": F.when(n >= 5, peak),
        "peak_ratio": F.when(n >= 5, F.when(mean_cc > 0, peak / mean_cc).otherwise(F.lit(1.0))),
        "is_peak": F.when(n >= 5, peak > mean_cc * 1.5),
        "peak_ts": F.when(n >= 5, F.col("_peak_ts")),
    }).drop(*STATE)


def aggregate_context(df: DataFrame, arr: str = "recent") -> DataFrame:
    """X2–X6 over a window array (<= 100 frames), as streams hold it:
    averages (clusterCount JS-rounded), dominant flow, trends, stability and
    peaks.  A table takes :func:`recent_context`, which makes no array."""
    a = F.col(arr)
    n = F.size(a)
    half = F.floor(n / 2).cast("int")
    out = df.withColumn("_n", n).withColumn("_s", _sums(a, SUMMED)) \
        .withColumn("_h1", _sums(F.slice(a, F.lit(1), half), _TRENDED)) \
        .withColumn("_h2", _sums(F.slice(a, half + 1, n - half), _TRENDED)) \
        .withColumn("_dirs", F.transform(a, lambda x: F.coalesce(x["flow_direction"], F.lit("unknown")))) \
        .withColumn("_ccs", F.transform(a, lambda x: _z(x["cluster_count"])))
    mean_cc, mean_dn = F.col("_s.cluster_count") / F.col("_n"), F.col("_s.avg_density") / F.col("_n")
    squares = F.aggregate(
        a, F.struct(F.lit(0.0).alias("cc"), F.lit(0.0).alias("dn")),
        lambda acc, x: F.struct((acc["cc"] + (_z(x["cluster_count"]) - mean_cc) * (_z(x["cluster_count"]) - mean_cc))
                                .alias("cc"),
                                (acc["dn"] + (_z(x["avg_density"]) - mean_dn) * (_z(x["avg_density"]) - mean_dn))
                                .alias("dn")))
    dirs = F.col("_dirs")
    best = F.array_max(F.transform(F.array_distinct(dirs), lambda v: F.struct(
        (F.col("_n") - F.size(F.array_remove(dirs, v))).alias("c"), F.array_position(dirs, v).alias("p"), v.alias("v"))))
    out = out.withColumn("_ss", squares).withColumn("_flow", best["v"]) \
        .withColumn("_flows", F.size(F.array_distinct(F.transform(a, lambda x: x["flow_direction"])))) \
        .withColumn("_peak", F.array_max("_ccs")) \
        .withColumn("_peak_ts", F.element_at(a, F.array_position("_ccs", F.col("_peak")).cast("int"))["ts"])
    return context_of(out).drop("_dirs", "_ccs")


def _window_state(w, pos: str, us: str) -> Column:
    """The state of a frame's window as one struct of aggregates over ``w``; ``pos`` numbers the rows.  Of each
    direction it keeps the count and the first place; a direction that the sensors don't name counts as unknown."""
    flow = F.col("flow_direction")
    known = F.when(flow.isin(DIRECTION_VALUES), flow).otherwise(F.lit("unknown"))
    cc = _z(F.col("cluster_count"))
    first_peak = F.max(F.struct(cc.alias("v"), (-F.col(us)).alias("t"))).over(w)
    best = F.array_max(F.array(*[F.struct(F.count_if(known == d).over(w).alias("c"),
                                          F.min(F.when(known == d, F.col(pos))).over(w).alias("p"),
                                          F.lit(d).alias("v")) for d in DIRECTION_VALUES]))
    named = [F.count_if(known == d).over(w) > 0 for d in DIRECTION_VALUES if d != "unknown"]
    others = [F.count_if(flow.isNotNull() & (known == "unknown")).over(w) > 0, F.count_if(flow.isNull()).over(w) > 0]
    flows = sum((c.cast("int") for c in named + others), F.lit(0))
    n = F.count(F.lit(1)).over(w)
    return F.struct(
        n.alias("n"),
        F.struct(*[F.sum(_z(F.col(m))).over(w).alias(m) for m in SUMMED]).alias("s"),
        F.struct((F.var_pop(cc).over(w) * n).alias("cc"),
                 (F.var_pop(_z(F.col("avg_density"))).over(w) * n).alias("dn")).alias("ss"),
        best["v"].alias("flow"), flows.alias("flows"), first_peak["v"].alias("peak"),
        F.timestamp_micros(-first_peak["t"]).alias("peak_ts"))


def _undated_context(frames: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The state of frames without a time: all those of their key are one window."""
    whole = Window.partitionBy(key).orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    u = frames.where(F.col(ts).isNull()).withColumn("_us", F.unix_micros(F.col(ts))) \
        .withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(tie))) \
        .withColumn("_half", F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) / 2))

    def part(cond):
        return F.struct(*[F.sum(F.when(cond, _z(F.col(m))).otherwise(0.0)).over(whole).alias(m) for m in _TRENDED])

    u = u.select("*", _window_state(whole, "_pos", "_us").alias("_w"), part(F.col("_pos") <= F.col("_half")).alias("_h1"),
                 part(F.col("_pos") > F.col("_half")).alias("_h2"))
    return u.withColumns({f"_{f}": F.col(f"_w.{f}") for f in ("n", "s", "ss", "flow", "flows", "peak", "peak_ts")}) \
        .select(*frames.columns, *STATE)


def recent_context(frames: DataFrame, key: str = "billboard_id", ts: str = "ts", tie: str = "frame_id",
                   max_frames: int = 100, horizon_s: int = 30, chunk_s: int = 120) -> DataFrame:
    """X1 + X2–X6: each frame with the context of its window.

    One shuffle on (billboard, chunk) puts the frames of a chunk in order; a
    pass over the sorted rows (:mod:`footfall.operators.trailing`) then takes
    the figures of each frame's window, ``max_frames`` vector steps a batch,
    and carries the last frames from batch to batch.  Nulls count 0 and an
    unknown direction; equal (ts, tie) rows come in any order; no rows give
    none.  Frames without a time are one window per billboard."""
    chunk_us, hz_us = chunk_s * 1_000_000, horizon_s * 1_000_000
    flow = F.col("flow_direction")
    named = [d for d in DIRECTION_VALUES if d != "unknown"]
    kind = F.when(flow.isNull(), len(named) + 1).when(flow.isin(named), F.array_position(F.array(*[F.lit(d) for d in named]), flow) - 1) \
        .otherwise(len(named)).cast("int")
    u = _chunked(frames.where(F.col(ts).isNotNull()), ts, chunk_us, hz_us).withColumn("_us", F.unix_micros(F.col(ts)))
    u = u.select(*frames.columns, "_own", "_us", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy("_us", tie)).alias("_pos"),
                 kind.alias("_kind"), *[_z(F.col(m)).alias(f"_m_{m}") for m in SUMMED])
    schema = StructType([*frames.schema.fields, *StructType.fromDDL(", ".join(f"_f_{c}" for c in TR.STATE)).fields])
    # the last two kinds, other directions and none, are one label
    label_of = [*range(len(named)), len(named), len(named)]
    got = u.mapInArrow(TR.with_state(list(frames.columns), label_of, max_frames, hz_us), schema)

    def group(prefix, fields):
        return F.struct(*[F.col(f"_f_{prefix}_{f}").alias(f) for f in fields])

    dated = got.select(
        *frames.columns, F.col("_f_n").alias("_n"), group("s", SUMMED).alias("_s"), group("h1", _TRENDED).alias("_h1"),
        group("h2", _TRENDED).alias("_h2"), group("ss", ("cc", "dn")).alias("_ss"),
        F.element_at(F.array(*[F.lit(d) for d in [*named, "unknown"]]), (F.col("_f_label") + 1).cast("int")).alias("_flow"),
        F.col("_f_kinds").cast("int").alias("_flows"), F.col("_f_peak").alias("_peak"), F.timestamp_micros("_f_peak_us").alias("_peak_ts"))
    both = dated.unionByName(_undated_context(frames, key, ts, tie))
    return context_of(both).select(*frames.columns, *CONTEXT_COLUMNS)


# ------------------------------------------------------------------ X7
_SUMS = (("cc", "cluster_count"), ("dn", "avg_density"), ("dw", "dwell_avg"), ("en", "engagement"))


def _first_key(df: DataFrame, ts: str, tie: str) -> Column:
    """Orders frames by (ts, tie).  With a whole-number tie it is one decimal, which a hash aggregate keeps in
    place; otherwise a struct."""
    if isinstance(df.schema[tie].dataType, IntegralType):
        return F.unix_micros(F.col(ts)).cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")
    return F.struct(F.col(ts), F.col(tie))


def _frame_parts(frames: DataFrame, ts: str, tie: str) -> DataFrame:
    """What a frame adds to a window: counts, quantised metrics, its direction and its place."""
    flow = F.coalesce(F.col("flow_direction"), F.lit("unknown"))
    flow = F.when(flow.isin(DIRECTION_VALUES), flow).otherwise(F.lit("unknown"))
    return frames.withColumn("_flow", flow).withColumn("_first", _first_key(frames, ts, tie)) \
        .withColumns({f"_{a}": q9(_z(F.col(m))) for a, m in _SUMS})


def _frame_aggregates() -> list[Column]:
    """The mergeable window state of plain frames (after :func:`_frame_parts`)."""
    out = [F.count(F.lit(1)).alias("n"), *[F.sum(f"_{a}").alias(f"s_{a}") for a, _ in _SUMS]]
    for i, d in enumerate(DIRECTION_VALUES):
        here = F.col("_flow") == d
        out += [F.count_if(here).alias(f"c{i}"), F.min(F.when(here, F.col("_first"))).alias(f"f{i}")]
    return out


def _merged() -> list[Column]:
    """The same state from states: counts and sums add up, the first appearance is the least."""
    added = ["n", *[f"s_{a}" for a, _ in _SUMS], *[f"c{i}" for i in range(len(DIRECTION_VALUES))]]
    return [F.sum(c).alias(c) for c in added] + [F.min(f"f{i}").alias(f"f{i}") for i in range(len(DIRECTION_VALUES))]


def _history_rows(state: DataFrame, key: str, kind: str, end: Column, length: int) -> DataFrame:
    """History rows of window states; the mode: most frequent, tie -> latest first appearance."""
    mode = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.col(f"f{i}").alias("f"), F.lit(d).alias("d"))
                                 for i, d in enumerate(DIRECTION_VALUES)]))["d"]
    return state.select(
        key, F.lit(kind).alias("window_type"), end.alias("ts"), F.lit(length * 1000).alias("duration_ms"),
        "n", *[(F.col(f"s_{a}") / F.lit(1e9) / F.col("n")).alias(b) for a, b in _SUMS],
        mode.alias("flow_direction"),
    )


def pane_states(frames: DataFrame, seconds: int, key: str = "billboard_id", ts: str = "ts", tie: str = "frame_id") -> DataFrame:
    """Window states of tumbling panes of ``seconds`` (``_pane``: start in
    seconds), anchored at the epoch: what every sliding window whose slide
    is a multiple of that is made of."""
    pane = (F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)) * seconds).cast("bigint")
    return _frame_parts(frames, ts, tie).groupBy(key, pane.alias("_pane")).agg(*_frame_aggregates())


def wider_panes(panes: DataFrame, seconds: int, key: str = "billboard_id") -> DataFrame:
    """Panes merged into panes of ``seconds`` (a multiple of theirs)."""
    pane = (F.floor(F.col("_pane") / F.lit(seconds)) * seconds).cast("bigint")
    return panes.groupBy(key, pane.alias("_pane")).agg(*_merged())


def _windows_of_panes(panes: DataFrame, kind: str, compat: bool, key: str) -> DataFrame:
    """History rows of a kind from panes as wide as its slide: a pane goes to length / slide windows."""
    dur, slide = WINDOW_KINDS[kind]
    length = dur + slide if compat else dur
    ends = F.sequence(F.col("_pane") + slide, F.col("_pane") + length, F.lit(slide).cast("bigint"))
    state = panes.withColumn("_end", F.explode(ends)).groupBy(key, "_end").agg(*_merged())
    return _history_rows(state, key, kind, F.timestamp_seconds("_end"), length)


def rolling_history(frames: DataFrame, kind: str, key: str = "billboard_id", ts: str = "ts", tie: str = "frame_id",
                    compat: bool = False) -> DataFrame:
    """One history row per (billboard, window) that holds frames:
    averages of cluster count, density, dwell, engagement (JS ``|| 0``) and
    the dominant flow.  Windows are sliding ``window(ts, dur, slide)``
    anchored at the epoch; ``compat=True`` reproduces the client quirk of
    averaging before pruning, i.e. a window of ``dur + slide``.  The row is
    stamped at the window end.

    Frames are combined into panes as wide as the slide and only panes are
    copied to their windows.  A stream copies the frames instead (one
    aggregation, so one state)."""
    dur, slide = WINDOW_KINDS[kind]
    if not frames.isStreaming:
        return _windows_of_panes(pane_states(frames, slide, key, ts, tie), kind, compat, key)
    length = dur + slide if compat else dur
    win = F.window(F.col(ts), f"{length} seconds", f"{slide} seconds")
    state = _frame_parts(frames, ts, tie).groupBy(key, win.alias("w")).agg(*_frame_aggregates())
    return _history_rows(state, key, kind, F.col("w.end"), length)


def all_history(frames: DataFrame, compat: bool = False, key: str = "billboard_id", ts: str = "ts",
                tie: str = "frame_id") -> DataFrame:
    """X7 for the four window kinds, unioned.  One pass over the frames makes
    5-second panes; each kind's panes are merged from the narrower kind's."""
    out, panes = None, None
    for kind, (_dur, slide) in sorted(WINDOW_KINDS.items(), key=lambda kv: kv[1][1]):
        panes = pane_states(frames, slide, key, ts, tie) if panes is None else wider_panes(panes, slide, key)
        h = _windows_of_panes(panes, kind, compat, key)
        out = h if out is None else out.unionByName(h)
    return out


# ------------------------------------------------------------------ X8
def _q9(c: Column) -> Column:
    return q9(c)


KIND_RANK = {"immediate": 0, "short": 1, "medium": 2, "long": 3}


def historical_baseline(ctx: DataFrame, hist: DataFrame, key: str = "billboard_id", ts: str = "ts",
                        tie: str = "frame_id", tz: str | None = None) -> DataFrame:
    """For each context row, the mean over *all* window kinds of the
    history rows stamped strictly before it on the same weekday with
    |hour difference| <= 1 (no wrap at midnight), and their dominant flow
    (tie: latest first appearance in stamp order).  No rows -> NULL
    baseline (no anomaly check).

    No theta join and no copied history.  What counts for a context row of
    local hour h is: hours h-1 to h+1 of the same weekday in earlier weeks, all
    of hour h-1 of its own day, and its own hour up to its time.  The first two
    come from one small row per (billboard, hour): added up over the weeks and
    joined on (billboard, hour).  Only the last needs the rows themselves, as a
    running aggregate per (billboard, hour), so a billboard's history is spread
    over as many tasks as it has hours."""
    hour_us = 3_600_000_000
    local_hour = F.floor(local_us(F.unix_micros(F.col(ts)), tz) / F.lit(hour_us)).cast("bigint").alias("_lh")
    rank = F.element_at(F.create_map(*[x for k, v in KIND_RANK.items() for x in (F.lit(k), F.lit(v))]),
                        F.col("window_type"))
    dir_idx = F.array_position(F.array(*[F.lit(d) for d in DIRECTION_VALUES]),
                               F.coalesce(F.col("flow_direction"), F.lit("unknown"))).cast("int")
    h = hist.select(
        key, local_hour, F.lit(1).alias("_is_hist"), F.lit(None).cast("string").alias("_tie"),
        (F.unix_micros(F.col(ts)) * 8 + rank + 1).alias("_ok"),
        # history averages are quantised to 1e-9 and summed exactly, so the
        # baseline does not depend on the order partial sums are combined in
        _q9(F.col("cluster_count")).alias("_cc"), _q9(F.col("avg_density")).alias("_dn"),
        _q9(F.col("dwell_avg")).alias("_dw"), _q9(F.col("engagement")).alias("_en"), dir_idx.alias("_di"))
    # context rows: only their key and time — the baseline is joined back to
    # the full context rows at the end, so the union stays narrow
    c = ctx.select(key, local_hour, F.lit(0).alias("_is_hist"), F.col(tie).cast("string").alias("_tie"),
                   (F.unix_micros(F.col(ts)) * 8).alias("_ok"))
    # the union feeds both the hour summary and the row pass: write it once
    u = materialize(c.unionByName(h, allowMissingColumns=True), "baseline-union")
    is_h = F.col("_is_hist") == 1
    sums = {"n": F.when(is_h, F.lit(1)).otherwise(F.lit(0)), "cc": F.col("_cc"), "dn": F.col("_dn"),
            "dw": F.col("_dw"), "en": F.col("_en")}
    for i in range(len(DIRECTION_VALUES)):
        sums[f"c{i}"] = F.when(F.col("_di") == i + 1, F.lit(1)).otherwise(F.lit(0))
    firsts = {f"f{i}": F.when(F.col("_di") == i + 1, F.col("_ok")) for i in range(len(DIRECTION_VALUES))}
    names = [*sums, *firsts]
    # one row per (billboard, hour) that holds any row
    hours = materialize(u.groupBy(key, "_lh").agg(*[F.sum(v).alias(k) for k, v in sums.items()],
                                                   *[F.min(v).alias(k) for k, v in firsts.items()]), "baseline-hours")
    day, hour = F.floor(F.col("_lh") / F.lit(24)).cast("bigint"), F.pmod(F.col("_lh"), F.lit(24))
    near = hours.withColumn("_to", F.explode(F.array(F.col("_lh") - 1, F.col("_lh"), F.col("_lh") + 1))) \
        .where(F.floor(F.col("_to") / F.lit(24)) == day).select(key, F.col("_to").alias("_lh"), *names)
    near = near.groupBy(key, "_lh").agg(*[F.sum(k).alias(k) for k in sums], *[F.min(k).alias(k) for k in firsts])
    weeks = Window.partitionBy(key, F.pmod(day, F.lit(7)), hour).orderBy("_lh").rowsBetween(Window.unboundedPreceding, -1)
    before = near.select(key, "_lh", *[F.sum(k).over(weeks).alias(f"_w_{k}") for k in sums],
                         *[F.min(k).over(weeks).alias(f"_w_{k}") for k in firsts])
    last = hours.where(hour < 23).select(key, (F.col("_lh") + 1).alias("_lh"), *[F.col(k).alias(f"_p_{k}") for k in names])
    carry = before.join(last, [key, "_lh"], "left").select(
        key, "_lh", *[(F.coalesce(f"_w_{k}", F.lit(0)) + F.coalesce(f"_p_{k}", F.lit(0))).alias(f"_c_{k}") for k in sums],
        *[F.least(f"_w_{k}", f"_p_{k}").alias(f"_c_{k}") for k in firsts])
    # order by a plain column (time, then context before history, then the
    # window kind) and add every running aggregate in one projection, so
    # they share a single Window operator (one sort)
    wr = Window.partitionBy(key, "_lh").orderBy("_ok").rowsBetween(Window.unboundedPreceding, 0)
    run = [F.coalesce(F.sum(v).over(wr), F.lit(0)).alias(f"_r_{k}") for k, v in sums.items()]
    run += [F.min(v).over(wr).alias(f"_r_{k}") for k, v in firsts.items()]
    j = u.select(key, "_lh", "_is_hist", "_tie", *run).where(F.col("_is_hist") == 0).join(carry, [key, "_lh"])
    j = j.select(key, "_tie", *[(F.col(f"_r_{k}") + F.col(f"_c_{k}")).alias(f"_r_{k}") for k in sums],
                 *[F.least(f"_r_{k}", f"_c_{k}").alias(f"_r_{k}") for k in firsts])
    mode = F.array_max(F.array(*[F.struct(F.col(f"_r_c{i}").alias("c"), F.col(f"_r_f{i}").alias("f"),
                                          F.lit(d).alias("d")) for i, d in enumerate(DIRECTION_VALUES)]))["d"]
    n = F.col("_r_n")
    base = j.select(
        key, "_tie",
        F.when(n > 0, n).alias("base_n"),
        F.when(n > 0, F.col("_r_cc") / F.lit(1e9) / n).alias("base_cluster_count"),
        F.when(n > 0, F.col("_r_dn") / F.lit(1e9) / n).alias("base_avg_density"),
        F.when(n > 0, F.col("_r_dw") / F.lit(1e9) / n).alias("base_dwell_avg"),
        F.when(n > 0, F.col("_r_en") / F.lit(1e9) / n).alias("base_engagement"),
        F.when(n > 0, mode).alias("base_flow_direction"),
    )
    return ctx.withColumn("_tie", F.col(tie).cast("string")).join(base, [key, "_tie"], "left").drop("_tie")


# ------------------------------------------------------------------ X9
def detect_anomalies(df: DataFrame, cc: str = "ctx_cluster_count", dwell: str = "ctx_dwell_avg",
                     flow: str = "ctx_flow_direction") -> DataFrame:
    """``anomalies`` array (empty without a baseline):
    crowd_surge/high when cluster > 3 × base, unusual_dwell/medium when
    dwell > 2.5 × base, flow_change/low when direction differs; with
    current, expected and ratio (NULL when the base is 0)."""
    el = "struct<type:string,severity:string,current_value:double,expected_value:double,ratio:double," \
         "current_pattern:string,expected_pattern:string>"
    has = F.col("base_n").isNotNull()

    def item(t, sev, cur, exp, ratio, cp, ep):
        return F.struct(F.lit(t).alias("type"), F.lit(sev).alias("severity"), cur.cast("double").alias("current_value"),
                        exp.cast("double").alias("expected_value"), ratio.alias("ratio"),
                        cp.cast("string").alias("current_pattern"), ep.cast("string").alias("expected_pattern"))

    none = F.lit(None)
    surge = F.when(has & (F.col(cc) > F.col("base_cluster_count") * 3.0),
                   item("crowd_surge", "high", F.col(cc), F.col("base_cluster_count"),
                        safe_div(F.col(cc), F.col("base_cluster_count")), none, none))
    dw = F.when(has & (F.col(dwell) > F.col("base_dwell_avg") * 2.5),
                item("unusual_dwell", "medium", F.col(dwell), F.col("base_dwell_avg"),
                     safe_div(F.col(dwell), F.col("base_dwell_avg")), none, none))
    fl = F.when(has & (F.col(flow) != F.col("base_flow_direction")),
                item("flow_change", "low", none, none, F.lit(None).cast("double"), F.col(flow),
                     F.col("base_flow_direction")))
    return df.withColumn("anomalies", F.array_compact(F.array(surge.cast(el), dw.cast(el), fl.cast(el))))


# ------------------------------------------------------------------ X10
def generate_insights(df: DataFrame, cc: str = "ctx_cluster_count", eng: str = "ctx_engagement",
                      us_col: str = "ts_us", tz: str | None = None) -> DataFrame:
    """``insights`` array of (type, confidence, recommendation):
    high_traffic .8 (cluster > 10) or low_traffic .7 (< 2); high_engagement
    .9 (> 0.7); crowd_building .8 (crowd trend increasing); one
    anomaly_detected .9 per anomaly; above_normal_traffic .7 when cluster >
    15 × the time-of-day density (.6/.8/.9/.4)."""
    el = "struct<type:string,confidence:double,recommendation:string,anomaly_type:string>"

    def ins(t, conf, rec, an=None):
        return F.struct(F.lit(t).alias("type"), F.lit(conf).alias("confidence"), F.lit(rec).alias("recommendation"),
                        (an if an is not None else F.lit(None)).cast("string").alias("anomaly_type")).cast(el)

    tod = time_of_day(hour_of_us(local_us(F.col(us_col), tz)))
    dens = F.element_at(F.create_map(*[x for k, v in TOD_DENSITY.items() for x in (F.lit(k), F.lit(v))]), tod)
    c = F.col(cc)
    first = F.array_compact(F.array(
        F.when(c > 10, ins("high_traffic", 0.8, "display_premium_content"))
        .when(c < 2, ins("low_traffic", 0.7, "display_attention_content")),
        F.when(F.col(eng) > 0.7, ins("high_engagement", 0.9, "extend_content_duration")),
        F.when(F.col("crowd_trend") == "increasing", ins("crowd_building", 0.8, "prepare_high_impact_content")),
    ))
    anomalies = F.transform(F.coalesce(F.col("anomalies"), F.array()),
                            lambda a: ins("anomaly_detected", 0.9, "monitor_situation", a["type"]))
    last = F.array_compact(F.array(F.when(c > dens * 15, ins("above_normal_traffic", 0.7, "capitalize_on_traffic"))))
    return df.withColumn("insights", F.concat(first, anomalies, last))


# ------------------------------------------------------------------ X11
#: Columns of a context that the update payload carries where they are there.
_PAYLOAD = {"location": "struct<lat:double,lng:double,accuracy:double>", "ambient_light": "string", "weather_conditions": "string",
            "age_distribution": "map<string,double>", "estimated_groups": "bigint", "demographic_confidence": "double"}


def context_payload(ctx: DataFrame, ts: str = "ts", tie: str = "frame_id", mode: str = "privacy_mode") -> Column:
    """The update payload of a context row: the figures, the billboard's
    location, ``environmental`` (light, weather) and ``demographic_inference``
    (age distribution, groups, confidence), which is null unless the row's
    privacy mode is known and not strict.  Columns the row lacks are null."""
    def have(c):
        return F.col(c) if c in ctx.columns else F.lit(None).cast(_PAYLOAD[c])

    open_mode = F.col(mode) != "strict" if mode in ctx.columns else F.lit(False)
    demographic = F.struct(have("age_distribution").alias("age_distribution"), have("estimated_groups").alias("estimated_groups"),
                           have("demographic_confidence").alias("confidence_score"))
    return F.struct(F.col(ts).alias("ts"), F.col(tie).alias(tie), have("location").alias("location"),
                    F.col("ctx_cluster_count").alias("cluster_count"), F.col("ctx_avg_density").alias("avg_density"),
                    F.col("ctx_flow_direction").alias("flow_direction"),
                    F.col("ctx_dwell_avg").alias("dwell_time_avg"), F.col("ctx_engagement").alias("engagement_score"),
                    F.struct(have("ambient_light").alias("ambient_light"), have("weather_conditions").alias("weather_conditions"))
                    .alias("environmental"),
                    F.when(open_mode, demographic).alias("demographic_inference"))


def context_snapshot(ctx: DataFrame, every_s: int = 5, key: str = "billboard_id", ts: str = "ts",
                     tie: str = "frame_id", fill_gaps: bool = False) -> DataFrame:
    """X11: the last context of each billboard in each ``every_s`` tick,
    with the fields of :func:`context_payload`.  ``fill_gaps`` repeats the last
    context in ticks without a frame (bounded by the billboard's own span).
    """
    payload = context_payload(ctx, ts, tie)
    tick = F.window(F.col(ts), f"{every_s} seconds")
    snap = ctx.groupBy(key, tick.alias("w")).agg(F.max_by(payload, F.struct(F.col(ts), F.col(tie))).alias("p"))
    snap = snap.select(key, F.col("w.end").alias("tick"), "p.*").withColumn("repeated", F.lit(False))
    if not fill_gaps:
        return snap
    # the tick grid is generated hour by hour (at most 3600 / every_s ticks
    # per row), never as one array spanning a billboard's whole history
    span = snap.groupBy(key).agg(F.min("tick").alias("t0"), F.max("tick").alias("t1"))
    hours = span.select(key, "t0", "t1", F.explode(F.sequence(
        F.date_trunc("hour", "t0"), F.date_trunc("hour", "t1"), F.expr("INTERVAL 1 HOUR"))).alias("h"))
    ticks = hours.select(key, "t0", "t1", F.explode(F.sequence(
        F.greatest("h", "t0"), F.least(F.timestamp_add("SECOND", F.lit(3600 - every_s), F.col("h")), F.col("t1")),
        F.expr(f"INTERVAL {every_s} SECONDS"))).alias("tick")).drop("t0", "t1")
    allt = ticks.join(snap, [key, "tick"], "left")
    from footfall.operators.asof import asof_last
    cols = [c for c in snap.columns if c not in (key, "tick", "repeated")]
    # only ticks that hold a frame carry a value (a struct of NULLs is not NULL)
    filled = asof_last(allt, key, "tick", ["tick"],
                       {"_p": F.when(F.col(tie).isNotNull(), F.struct(*[F.col(c) for c in cols]))},
                       bucket_us=86_400_000_000)
    return filled.select(key, "tick", *[F.col(f"_p.{c}").alias(c) for c in cols],
                         F.col("repeated").isNull().alias("repeated"))


# ------------------------------------------------------------------ X12
# Anomaly type -> handling action
ANOMALY_ACTIONS = {
    "crowd_surge": "switch_to_high_capacity_content",
    "unusual_dwell": "extend_current_content",
    "flow_change": "monitor_situation",
}


def anomaly_log(df: DataFrame, keep: tuple[str, ...] = ("billboard_id", "frame_id", "ts")) -> DataFrame:
    """One row per anomaly with its handling action."""
    act = F.create_map(*[x for k, v in ANOMALY_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return df.select(*keep, F.explode("anomalies").alias("a")).select(
        *keep, F.col("a.type").alias("anomaly_type"), F.col("a.severity").alias("severity"),
        F.col("a.ratio").alias("ratio"), F.element_at(act, F.col("a.type")).alias("action"))
