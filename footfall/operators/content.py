"""Content scoring and selection on the rolling context, and the
playback facts derived from the choices (W7 rotation, O3 viewers)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.jsmath import exact_sum, js_round
from footfall.operators.asof import prev_row
from footfall.sources import lookups as L

def score_content(ctx: DataFrame, catalogue=None, cc: str = "ctx_cluster_count", eng: str = "ctx_engagement",
                  tod: str = "time_of_day") -> DataFrame:
    """O1: ``scores`` = array of (pos, content_id, score) per context row.

    The catalogue is a list of configuration rows (default: the schedule), so
    each item becomes a literal expression: a projection, no join.  Score = base (high 100 /
    medium 50 / else 25) + 30 if minCrowd (truthy) and crowd >= it + 20 if
    maxCrowd and crowd <= it + 25 if minEngagement and engagement >= it +
    30 if lowEngagement and engagement < 0.4 + 15 if the time of day is
    listed + 5 · ln(revenue + 1).  The demographics target is ignored."""
    items = []
    c, e, t = F.col(cc), F.col(eng), F.col(tod)
    for row in catalogue if catalogue is not None else L.CONTENT_SCHEDULE:
        pos, cid, prio, min_c, max_c, min_e, low_e, tods, rev = row[:9]
        s = F.lit(100.0 if prio == "high" else 50.0 if prio == "medium" else 25.0)
        if min_c:
            s = s + F.when(c >= min_c, 30.0).otherwise(0.0)
        if max_c:
            s = s + F.when(c <= max_c, 20.0).otherwise(0.0)
        if min_e:
            s = s + F.when(e >= min_e, 25.0).otherwise(0.0)
        if low_e:
            s = s + F.when(e < 0.4, 30.0).otherwise(0.0)
        if tods:
            s = s + F.when(t.isin(list(tods)), 15.0).otherwise(0.0)
        s = s + F.lit(math.log((rev or 0.0) + 1) * 5)
        items.append(F.struct(F.lit(pos).alias("pos"), F.lit(cid).alias("content_id"), s.alias("score")))
    return ctx.withColumn("scores", F.array(*items))


def select_content(scored: DataFrame) -> DataFrame:
    """O2: the best score; on a tie the earliest catalogue entry wins."""
    best = F.array_max(F.transform("scores", lambda x: F.struct(x["score"].alias("s"), (-x["pos"]).alias("np"),
                                                                x["content_id"].alias("id"))))
    return scored.withColumn("selected_content", best["id"]).withColumn("selected_score", best["s"])


def estimated_viewers(cluster_count: Column) -> Column:
    """O3: max(1, JS-round(1.2 · clusterCount))."""
    return F.greatest(F.lit(1), js_round(cluster_count * F.lit(1.2)))


def content_rotation(df: DataFrame, key: str = "billboard_id", ts: str = "ts", tie: str = "frame_id",
                     col: str = "selected_content", reason: str = "context_driven") -> DataFrame:
    """A rotation whenever the selected content differs from the
    previous choice of the same billboard (the first choice too, with a NULL
    previous).  Lag with a per-hour carry-in (see ``prev_row``)."""
    p = prev_row(df, key, ts, [ts, tie], [col])
    return p.where(F.col(f"prev_{col}").isNull() | (F.col(f"prev_{col}") != F.col(col))) \
        .withColumnRenamed(f"prev_{col}", "previous_content").withColumn("new_content", F.col(col)) \
        .withColumn("reason", F.lit(reason))


def content_rule(ctx: DataFrame, cc: str = "ctx_cluster_count", eng: str = "ctx_engagement") -> DataFrame:
    """O5 (documented rule): crowd > 10 and engagement > 0.7 -> premium;
    crowd < 3 -> interactive; else keep the current content."""
    return ctx.withColumn("content_rule", F.when((F.col(cc) > 10) & (F.col(eng) > 0.7), "premium")
                          .when(F.col(cc) < 3, "interactive").otherwise("keep"))


def catalogue_facts(catalogue=None) -> Column:
    """Map content id -> struct(revenue, duration_ms) as a literal."""
    rows = catalogue if catalogue is not None else L.CONTENT_SCHEDULE
    return F.create_map(*[x for r in rows for x in (F.lit(r[1]), F.struct(F.lit(r[8]).alias("revenue"),
                                                                          F.lit(r[9]).alias("duration_ms")))])


def impressions(rotations: DataFrame, catalogue=None, cc: str = "ctx_cluster_count",
                eng: str = "ctx_engagement") -> DataFrame:
    """Each displayed content is one impression (as the player tracks it):
    estimated viewers, content duration and revenue value."""
    f = F.element_at(catalogue_facts(catalogue), F.col("new_content"))
    return rotations.select("*", estimated_viewers(F.col(cc)).alias("estimated_viewers"),
                            f["duration_ms"].alias("duration_ms"), f["revenue"].alias("revenue"),
                            F.col(eng).alias("engagement_score"), F.col(cc).alias("crowd_size")) \
        .withColumnRenamed("new_content", "content_id")


def content_lift(imps: DataFrame) -> DataFrame:
    """O4 (ours on documented fields): by content: impressions, average
    viewers, average engagement, revenue per impression."""
    return imps.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.avg("estimated_viewers").alias("avg_viewers"),
        (exact_sum("engagement_score").cast("double") / F.count(F.lit(1))).alias("engagement_rate"),
        (F.sum("revenue") / F.count(F.lit(1))).alias("revenue_per_impression"))
