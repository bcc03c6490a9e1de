"""The weighted, expiring intent graph and the analytics on it.

Edges are rows ``(uuid, relation, target_type, target, weight, ts,
expires_at)``; all graph work is group-by / window / equi-join on those
rows.  Only G1–G3 and G5 semantics come from the client documentation; the
rest are our definitions (stated per function)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.jsmath import q9
from footfall.session import materialize
from footfall.sources import lookups as L


def _map_lit(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def intent_edges(df: DataFrame) -> DataFrame:
    """G1: event -> edge.  Relation and weight come from a fixed map;
    ``expires_at = ts + ttl`` (the event's stamped TTL is the truth).
    Events of other types produce no edge; ``unfavorite`` is kept as a
    zero-weight cancel edge for G2."""
    rel = _map_lit({k: v[0] for k, v in L.EDGE_RELATIONS.items()} | {"unfavorite": "unfavorited"})
    ttype = _map_lit({k: v[1] for k, v in L.EDGE_RELATIONS.items()} | {"unfavorite": "entity"})
    weight = _map_lit({k: v[2] for k, v in L.EDGE_RELATIONS.items()} | {"unfavorite": 0.0})
    et = F.col("event_type")
    ctx = F.col("context")
    target = (
        F.when(et == "search", F.coalesce(F.lower(F.trim(ctx["search_query"])), F.col("entity_id")))
        .when(et == "tag_interaction", F.coalesce(ctx["tag_id"], F.col("entity_id")))
        .when(et.startswith("map_"), F.coalesce(ctx["area"], F.col("entity_id")))
        .when(et == "impression", F.coalesce(ctx["content_id"], F.col("entity_id")))
        .otherwise(F.col("entity_id"))
    )
    return (
        df.where(F.element_at(rel, et).isNotNull())
        .select(
            "uuid",
            "event_type",
            F.element_at(rel, et).alias("relation"),
            F.element_at(ttype, et).alias("target_type"),
            target.alias("target"),
            F.element_at(weight, et).alias("weight"),
            F.coalesce(ctx["category"], F.lit("unknown")).alias("category"),
            "ts",
            F.timestamp_add("SECOND", F.col("ttl"), F.col("ts")).alias("expires_at"),
        )
        .where(F.col("target").isNotNull())
    )


def edge_weights(edges: DataFrame, as_of: Column) -> DataFrame:
    """Σ weight of live edges per (user, relation, target), last seen.

    Live = ``ts <= as_of < expires_at``.  An ``unfavorite`` cancels the
    same user's earlier favourites of that target (our rule).  The cancel
    list is the small side of an equi-join with a range condition (AQE
    broadcasts it when its run-time size is small); the sum is a partial +
    final aggregate (map-side combine), so a hot user only costs one row per
    target after the partial step."""
    live = edges.where((F.col("ts") <= as_of) & (F.col("expires_at") > as_of))
    cancels = (
        live.where(F.col("event_type") == "unfavorite")
        .groupBy("uuid", "target")
        .agg(F.max("ts").alias("cancel_ts"))
    )
    # one anti join over all live edges; only favourites can match a cancel
    kept = live.where(F.col("relation") != "unfavorited").alias("f").join(
        cancels.alias("c"),
        (F.col("f.uuid") == F.col("c.uuid")) & (F.col("f.target") == F.col("c.target"))
        & (F.col("f.relation") == "favorited") & (F.col("f.ts") < F.col("c.cancel_ts")),
        "left_anti",
    )
    return kept.groupBy("uuid", "relation", "target_type", "target").agg(
        F.sum("weight").alias("weight"),
        F.count(F.lit(1)).alias("n_edges"),
        F.max("ts").alias("last_seen"),
        F.max_by("category", F.struct("ts", "category")).alias("category"),
    )


def adjacency_topk(weights: DataFrame, k: int) -> DataFrame:
    """The k strongest targets per user (ties: target name).

    ``row_number() <= k`` is planned as a window-group limit, applied
    partially before the shuffle, so a hot user ships at most k rows per
    task."""
    w = Window.partitionBy("uuid").orderBy(F.col("weight").desc(), F.col("relation"), F.col("target"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def intent_score(weights: DataFrame) -> DataFrame:
    """G4 (ours): per user and category, the live weight and its share of
    the user's total live weight.  The per-user window runs over the
    already aggregated (user, category) rows — at most one row per
    category."""
    per = weights.groupBy("uuid", "category").agg(F.sum("weight").alias("weight"))
    tot = F.sum("weight").over(Window.partitionBy("uuid"))
    return per.withColumn("score", F.col("weight") / tot)


def intent_stage(df: DataFrame) -> DataFrame:
    """G5 (thresholds ours): per (user, entity) the highest stage reached —
    shared (any share) > explored (>= 2 distinct event types) > returned
    (>= 2 distinct sessions) > discovered (viewed) > touched."""
    views = ("view_venue", "view_event", "view_content")
    g = df.where(F.col("entity_id").isNotNull()).groupBy("uuid", "entity_id").agg(
        F.min(F.when(F.col("event_type").isin(*views), F.col("ts"))).alias("first_view"),
        F.count_distinct("session_id").alias("sessions"), F.count_distinct("event_type").alias("types"),
        F.max(F.when(F.col("event_type") == "share", F.lit(1)).otherwise(F.lit(0))).alias("shared"))
    stage = (F.when(F.col("shared") == 1, "shared").when(F.col("types") >= 2, "explored")
             .when(F.col("sessions") >= 2, "returned").when(F.col("first_view").isNotNull(), "discovered")
             .otherwise("touched"))
    return g.withColumn("stage", stage)


def audience_segment(scores: DataFrame, tiers: tuple[float, float, float] = (5.0, 20.0, 50.0)) -> DataFrame:
    """G6 (ours): dominant category (largest share; tie: the alphabetically
    last) and an activity tier from fixed total-weight thresholds (casual <
    light < regular < heavy) — no global sort or quantile pass is needed."""
    g = scores.groupBy("uuid").agg(
        F.max_by("category", F.struct(F.col("score"), F.col("category"))).alias("dominant_category"),
        F.sum("weight").alias("total_weight"))
    t = F.col("total_weight")
    tier = F.when(t >= tiers[2], "heavy").when(t >= tiers[1], "regular").when(t >= tiers[0], "light") \
        .otherwise("casual")
    return g.withColumn("activity_tier", tier)


# Fixed values (ours): purchase-intent weights per event type
PURCHASE_INTENT = {"add_to_cart": 1.0, "checkout_started": 2.0, "purchase": 3.0}


def intent_trigger(df: DataFrame, threshold: float = 3.0, window_days: int = 7,
                   weights: dict[str, float] | None = None, rule: str = "high_purchase_intent",
                   chunk_days: int = 28) -> DataFrame:
    """G7 (ours): users whose trailing ``window_days`` intent weight
    reaches ``threshold``; a row is emitted only on the crossing (the
    previous event of the user was below).  The trailing sum is a range
    window cut into ``chunk_days`` chunks (see ``chunked_range``) and the
    previous value comes from the bucketed ``prev_row``."""
    from footfall.operators.asof import chunked_range, prev_row
    wmap = weights or PURCHASE_INTENT
    m = F.create_map(*[x for k, v in wmap.items() for x in (F.lit(k), F.lit(v))])
    ev = df.where(F.col("event_type").isin(list(wmap))).withColumn("_w", F.element_at(m, F.col("event_type")))
    day = 86_400_000_000
    ev = chunked_range(ev, "uuid", "ts", window_days * day, chunk_days * day,
                       {"trailing_weight": lambda w: F.sum("_w").over(w)})
    p = prev_row(ev, "uuid", "ts", ["ts", "event_id"], ["trailing_weight"], bucket_us=chunk_days * day)
    prev = F.col("prev_trailing_weight")
    return p.where((F.col("trailing_weight") >= threshold) & (prev.isNull() | (prev < threshold))) \
        .withColumn("rule", F.lit(rule)).drop("_w", "prev_trailing_weight")


def geo_cell(c: Column, size_deg: float = 0.1) -> Column:
    """City-level cell: the coordinate rounded to ``size_deg``."""
    return F.round(c / F.lit(size_deg), 0) * F.lit(size_deg)


def heatmap(df: DataFrame, k_anon: int = 3, size_deg: float = 0.1) -> DataFrame:
    """Events by geo cell × hour × category, published only when at
    least ``k_anon`` distinct users fall in the cell (k-anonymity floor)."""
    from footfall.functions.timeparts import hour_of_us
    g = df.where(F.col("geo.lat").isNotNull()).groupBy(
        geo_cell(F.col("geo.lat"), size_deg).alias("cell_lat"), geo_cell(F.col("geo.lng"), size_deg).alias("cell_lng"),
        hour_of_us(F.unix_micros("ts")).alias("hour"), F.col("context")["category"].alias("category")) \
        .agg(F.count(F.lit(1)).alias("events"), F.count_distinct("uuid").alias("users"))
    return g.where(F.col("users") >= k_anon)


def geo_trending(df: DataFrame, k: int = 3, size_deg: float = 0.1, window: str = "1 day") -> DataFrame:
    """G9 (ours): per tumbling window, the k (cell, category) with the
    highest growth over the previous window of the same cell and category
    (cells new in a window have no growth and are not ranked)."""
    g = df.where(F.col("geo.lat").isNotNull()).groupBy(
        F.window("ts", window).alias("w"), geo_cell(F.col("geo.lat"), size_deg).alias("cell_lat"),
        geo_cell(F.col("geo.lng"), size_deg).alias("cell_lng"), F.col("context")["category"].alias("category")) \
        .agg(F.count(F.lit(1)).alias("events"))
    wl = Window.partitionBy("cell_lat", "cell_lng", "category").orderBy("w.start")
    g = g.withColumn("prev_start", F.lag("w.start").over(wl)).withColumn("prev_events", F.lag("events").over(wl))
    dur = F.col("w.end").cast("long") - F.col("w.start").cast("long")
    consecutive = (F.col("w.start").cast("long") - F.col("prev_start").cast("long")) == dur
    g = g.withColumn("prev_events", F.when(consecutive, F.col("prev_events")).otherwise(F.lit(0)))
    g = g.withColumn("growth", F.try_divide((F.col("events") - F.col("prev_events")).cast("double"),
                                            F.col("prev_events"))).where(F.col("growth").isNotNull())
    wr = Window.partitionBy("w").orderBy(F.col("growth").desc(), "cell_lat", "cell_lng", "category")
    return g.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= k)


def cohort_retention(df: DataFrame) -> DataFrame:
    """First-seen week cohort × week offset: active users."""
    wk = F.floor((F.unix_micros("ts") / F.lit(86_400_000_000) + 3) / 7).cast("bigint")  # Monday-based weeks
    e = df.select("uuid", wk.alias("week")).distinct()
    first = e.groupBy("uuid").agg(F.min("week").alias("cohort_week"))
    return e.join(first, "uuid").groupBy("cohort_week", (F.col("week") - F.col("cohort_week")).alias("week_offset")) \
        .agg(F.count(F.lit(1)).alias("active_users"))


def funnel(df: DataFrame, steps: list[str], within_days: int = 7) -> DataFrame:
    """Per user, the first time each step is reached after the
    previous one (strictly later, all within ``within_days`` of step 1).
    One partial aggregate per step, chained by joins on the user — no
    per-user list is gathered.  Returns (uuid, step_1_ts, ..., steps_done)."""
    seen = df.where(F.col("event_type").isin(steps)).select("uuid", "event_type", F.col("ts").alias("_t"))
    out = seen.where(F.col("event_type") == steps[0]).groupBy("uuid").agg(F.min("_t").alias("step_1_ts"))
    for i, step in enumerate(steps[1:], start=2):
        before = [f"step_{k}_ts" for k in range(1, i)]
        reached = (F.col("_t") > F.col(before[-1])) & (F.col("_t") <= F.timestamp_add("DAY", F.lit(within_days), F.col("step_1_ts")))
        # One branch per step: the user's earlier times are carried through the aggregate.
        out = out.join(seen.where(F.col("event_type") == step).drop("event_type"), "uuid", "left").groupBy("uuid", *before) \
            .agg(F.min(F.when(reached, F.col("_t"))).alias(f"step_{i}_ts"))
    done = sum((F.col(f"step_{i}_ts").isNotNull().cast("int") for i in range(1, len(steps) + 1)), F.lit(0))
    return out.withColumn("steps_done", done)


def funnel_counts(per_user: DataFrame, steps: list[str]) -> DataFrame:
    """G11 report: users reaching each step."""
    aggs = [F.count(F.col(f"step_{i}_ts")).alias(f"n{i}") for i in range(1, len(steps) + 1)]
    row = per_user.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"),
                                                   F.col(f"n{i}").alias("users"))
                                          for i, s in enumerate(steps, start=1)])).alias("x")).select("x.*")


def attribution(df: DataFrame, lookback_days: int = 7, model: str = "last") -> DataFrame:
    """Each purchase is credited to the last (``model='last'``) or
    first (``'first'``) utm touch of the same user within the lookback, or in
    equal parts to all of them (``'linear'``: a row per purchase and source).
    Last touch uses the bucketed as-of helper with the lookback as age
    limit; first touch is a range-window ``min_by``."""
    from footfall.operators.asof import asof_last
    utm = F.col("context")["utm_source"]
    rel = df.where((F.col("event_type") == "purchase") | utm.isNotNull()).withColumn("_utm", utm)
    if model == "last":
        got = asof_last(rel, "uuid", "ts", ["ts", "event_id"], {"touch": F.col("_utm")},
                        max_age_us=lookback_days * 86_400_000_000)
        return got.where(F.col("event_type") == "purchase").select(
            "event_id", "uuid", "ts", F.col("touch").alias("credited_source"), F.col("touch_ts"))
    # first touch: a range-window min_by over (ts - lookback, ts], chunked
    from footfall.operators.asof import chunked_range
    day = 86_400_000_000
    if model == "linear":
        return _linear_attribution(rel, lookback_days)
    first = lambda w: F.min_by(F.struct(F.col("_utm").alias("s"), F.col("ts").alias("t")),
                               F.when(F.col("_utm").isNotNull(), F.struct("ts", "event_id"))).over(w)
    got = chunked_range(rel, "uuid", "ts", lookback_days * day + 1, max(4 * lookback_days, 28) * day, {"_f": first})
    return got.where(F.col("event_type") == "purchase").select(
        "event_id", "uuid", "ts", F.col("_f.s").alias("credited_source"), F.col("_f.t").alias("touch_ts"))


def _linear_attribution(rel: DataFrame, lookback_days: int) -> DataFrame:
    """(event_id, uuid, ts, credited_source, touches, credit) per purchase and source.

    Per source the touches in the lookback are a range-window count over the
    user's rows, so nothing is collected: purchases are copied once per
    source the user has at all, and a user is cut into chunks of time."""
    from footfall.operators.asof import chunked_range
    day = 86_400_000_000
    touches = rel.where(F.col("_utm").isNotNull()).select("uuid", "ts", F.col("_utm").alias("credited_source"), F.lit(1).alias("_t"))
    sources = touches.select("uuid", "credited_source").distinct()
    bought = rel.where(F.col("event_type") == "purchase").select("event_id", "uuid", "ts").join(sources, "uuid") \
        .withColumn("_t", F.lit(0))
    both = bought.unionByName(touches, allowMissingColumns=True)
    got = chunked_range(both, ["uuid", "credited_source"], "ts", lookback_days * day + 1, max(4 * lookback_days, 28) * day,
                        {"touches": lambda w: F.sum("_t").over(w)}).where((F.col("_t") == 0) & (F.col("touches") > 0))
    total = got.groupBy("event_id").agg(F.sum("touches").alias("_all"))
    return got.join(total, "event_id").select("event_id", "uuid", "ts", "credited_source", "touches",
                                             (F.col("touches") / F.col("_all")).alias("credit"))


def lookalike(scores: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """G13 (ours): users (not seeds) most similar, by cosine, to the mean
    category-share vector of the seed users (a seed without a category
    counts 0 there).  Vectors stay as rows (user, category, score); the
    mean vector has one row per category, the seed count and its norm are
    scalar subqueries, and the ranking is a global top-k."""
    seed_ids = seeds.select("uuid").distinct().withColumn("is_seed", F.lit(True))
    # Written once: the seeds' mean, its norm and the candidates all read it.
    scores = materialize(scores.select("uuid", "category", "score").join(seed_ids, "uuid", "left"), "lookalike-scores")
    s = scores.where("is_seed")
    n_seeds = s.select(F.count_distinct("uuid")).scalar()
    mean = s.groupBy("category").agg((F.sum("score") / n_seeds).alias("m"))
    norm_mean = mean.select(F.sqrt(F.sum(F.col("m") * F.col("m")))).scalar()
    cand = scores.where("is_seed is null")
    dots = cand.join(mean, "category", "left").groupBy("uuid").agg(
        F.sum(F.col("score") * F.coalesce(F.col("m"), F.lit(0.0))).alias("dot"),
        F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("nu"))
    sim = dots.withColumn("similarity", F.try_divide(F.col("dot"), F.col("nu") * norm_mean))
    return sim.orderBy(F.col("similarity").desc(), "uuid").limit(k).select("uuid", "similarity")


SIGNATURE_BANDS = 16
BAND_BITS = 8


def category_signatures(scores: DataFrame, key: str | None = "uuid", bands: int = SIGNATURE_BANDS,
                        bits: int = BAND_BITS) -> DataFrame:
    """Random-hyperplane signatures of category vectors: one row per ``key``
    (one row in all for None) with ``bands``, an array of ``bands`` band keys.

    A bit is the side of one plane that the vector lies on.  A plane's part in a
    category is the number of ones among 60 hashed bits less its mean, close to
    a normal variable and the same in every job, so signatures made on different
    days can be compared.  Two vectors at angle a agree in a bit with probability
    1 - a/pi and share one of 16 bands of 8 bits with 1 - (1 - (1 - a/pi)^8)^16:
    0.99 at a cosine of 0.9, 0.99999 at 0.97.  The planes are computed once per
    category, the sums are partial aggregates of longs (scores by 1e-9: exact in
    any order).  A null score counts 0, a null category is one of its own."""
    planes = range(bands * bits)
    name = F.coalesce(F.concat(F.lit("c:"), F.col("category")), F.lit("n"))
    hashed = [F.substring(F.md5(F.concat_ws(":", F.lit(str(i)), "_name")), 1, 15) for i in planes]
    parts = F.array(*[(F.bit_count(F.conv(h, 16, 10).cast("bigint")) - 30).cast("int") for h in hashed])
    named = scores.withColumn("_name", name)
    sums = named.join(named.select("_name").distinct().withColumn("_parts", parts), "_name") \
        .groupBy(*([key] if key else [])) \
        .agg(*[F.sum(q9(F.coalesce("score", F.lit(0.0))) * F.col("_parts")[i]).alias(f"_p{i}") for i in planes])
    band = [F.lit(b << bits) + sum(((F.col(f"_p{b * bits + i}") >= 0).cast("int") * (1 << i) for i in range(bits)), F.lit(0))
            for b in range(bands)]
    return sums.select(*([key] if key else []), F.array(*band).alias("bands"))


def signature_index(signatures: DataFrame, path: str, key: str = "uuid") -> DataFrame:
    """Signatures as a stored table with a row per (band, key), a folder per band:
    a lookup reads the users of its own bands, parquet skips the rest.  Any band
    may hold any share of the users, so a folder is written by many tasks."""
    rows = signatures.select(key, F.explode("bands").alias("band_key")) \
        .withColumn("band", F.shiftright("band_key", BAND_BITS))
    rows.sortWithinPartitions("band", "band_key").write.mode("overwrite").partitionBy("band").parquet(path)
    return signatures.sparkSession.read.parquet(path)


def lookalike_by_signature(scores: DataFrame, seeds: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """G13 at size: as :func:`lookalike`, but only users who share a signature
    band with the seeds' mean vector are scored (exactly).  ``index`` is
    :func:`signature_index` of all users.

    The mean has one signature, so the lookup joins the index with 16 rows.  A user
    is missed with the probability stated at :func:`category_signatures`; users
    unlike the mean are left out, so fewer than ``k`` rows may come back where
    fewer are alike.  :func:`lookalike` is the exact form.  No seeds, no rows."""
    seed_ids = seeds.select("uuid").distinct()
    seed_scores = scores.join(seed_ids, "uuid", "left_semi")
    mean = category_signatures(seed_scores.select("category", "score"), None)
    # 16 rows: one per band
    wanted = F.broadcast(mean.select(F.explode("bands").alias("band_key")))
    alike = index.join(wanted, "band_key").select("uuid").distinct()
    near = scores.join(alike, "uuid", "left_semi").join(seed_ids, "uuid", "left_anti")
    return lookalike(seed_scores.unionByName(near), seeds, k)


def temporal_profile(df: DataFrame, by: str = "category") -> DataFrame:
    """Hour-of-day usage per category, split weekday / weekend; one
    pivot with the 24 known hour values (no extra pass to find them)."""
    from footfall.functions.timeparts import dow0_of_us, hour_of_us
    us = F.unix_micros("ts")
    d = df.select(F.col("context")[by].alias(by) if by == "category" else F.col(by),
                  F.when(dow0_of_us(us).isin(0, 6), "weekend").otherwise("weekday").alias("day_type"),
                  hour_of_us(us).alias("hour"))
    return d.groupBy(by, "day_type").pivot("hour", list(range(24))).count().na.fill(0)
