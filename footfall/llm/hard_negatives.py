"""Hard negatives by threshold joins over an inverted index with norm bounds.

Scores are inner products of integer vectors.  A search wants, per anchor and
score window, the first k rows of a window.  It starts with a high threshold,
joins all rows that reach it, settles the windows that are filled and lowers
the threshold of the others, down to the window's lower end.  A row at or above
the threshold is never missed, so a filled window is exact, and what remains
open after the last round has been searched whole.

A join is cut into blocks of anchors and blocks of rows, dealt by hash, so no
group is larger than a block.  Inside a pair of blocks the rows are indexed by
dimension (largest first).  A row's dimensions whose suffix norm cannot lift
any anchor over its threshold are left out of the index: the rows posted
under a dimension are a prefix when rows are sorted by where their index ends.
Scores are added up dimension by dimension, pairs whose score so far plus the
product of the remaining norms (Cauchy-Schwarz) stays under the threshold are
dropped, and the omitted dimensions of those left are added with the same test.

Sums are exact: single precision is used where no partial sum can leave 2^24,
double up to 2^53, longs beyond.

Defined cases.  Rows with a null label or vector, a null, NaN or infinite entry,
or a squared length of 2^62 or more (its scores would not fit a long) take no
part, nor do vectors of another length than most.  A row of the anchor's own
vec_id is not among its positives or negatives.  Null ids are no anchors and
come last among equal scores.  Repeated rows each count; every row of a repeated
anchor id is an anchor of its own.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import materialize

SCALE = 256
#: Rows and anchors of one block; a task holds one block of each.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 16384
#: Anchors scored together, dimensions added at a time.
STRIP, STEP = 64, 8
#: When this share of pairs or less is left, they are followed one by one.
SPARSE = 0.02
FAR = 2**62


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(row_no, vec_id, label, x, self) of the rows that take part; x = floor(256 * c) in the narrowest integer type."""
    wide = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda c: F.lit(float(SCALE)) * c.cast("double")).alias("v"),
    )
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < 2.0**31, F.lit(False))) & (F.size("v") > 0)
    wide = wide.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & usable)
    commonest = wide.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d"))
    rows = wide.filter(F.size("v") == commonest.scalar()).select("vec_id", "label", F.transform("v", lambda c: F.floor(c)).alias("x"))
    length = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = rows.filter(length < float(FAR)).withColumn("self", F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c))
    rows = materialize(rows.withColumn("row_no", F.monotonically_increasing_id()), "negatives-rows")
    most = rows.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0] or 0
    kind = "smallint" if most < 2**15 else "int" if most < 2**31 else "long"
    return rows.withColumn("x", F.col("x").cast(f"array<{kind}>"))


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def exact_kind(most_squared: int):
    """The fastest type in which no partial sum of a score is rounded."""
    return np.float32 if most_squared < 2**24 else np.float64 if most_squared < 2**53 else np.int64


class Index:
    """Rows of a block by dimension, without what no anchor of relative threshold ``theta`` needs."""

    def __init__(self, rows: np.ndarray, theta: float):
        self.dims = np.argsort(-(rows.astype(float) ** 2).sum(0), kind="stable")
        rows = rows[:, self.dims]
        d = rows.shape[1]
        self.steps = [(a, min(a + STEP, d)) for a in range(0, d, STEP)]
        left = suffix_norms(rows)
        # Dimensions from ``ends`` on are omitted: their norm times any anchor's stays under that anchor's threshold.
        ends = (left[:, :-1] * SLACK >= theta).sum(1) if theta > 0 else np.full(len(rows), d)
        ends = np.minimum(-(-ends // STEP) * STEP, d)
        self.order = np.argsort(-ends, kind="stable")
        self.rows, self.left, self.ends = rows[self.order], left[self.order], ends[self.order]

    def reaching(self, anchors: np.ndarray, limits: np.ndarray):
        """(anchor, row, score) of all pairs with score >= the anchor's limit."""
        anchors = anchors[:, self.dims]
        rest = suffix_norms(anchors)
        # Sums of large longs and norms are rounded: what is dropped on the way lies under the limit by more than that.
        exact, limits = limits, (limits - 1e-12 * np.abs(limits))[:, None]
        total = np.zeros((len(anchors), len(self.rows)), self.rows.dtype)
        done = self.ends
        for a, b in self.steps:
            m = int(np.searchsorted(-self.ends, -b, side="right"))
            if not m:
                break
            total[:, :m] += anchors[:, a:b] @ self.rows[:m, a:b].T
            if b % (4 * STEP) == 0 and (total[:, :m] + SLACK * rest[:, b, None] * self.left[:m, b] >= limits).mean() <= SPARSE:
                done = np.minimum(self.ends, b)
                break
        bound = total + SLACK * rest[:, done] * self.left[np.arange(len(done)), done]
        who, row = np.nonzero(bound >= limits)
        score = total[who, row]
        for a, b in self.steps:
            late = np.nonzero(done[row] <= a)[0]
            if len(late):
                score[late] += np.einsum("ij,ij->i", anchors[who[late], a:b], self.rows[row[late], a:b])
                able = np.ones(len(row), bool)
                able[late] = score[late] + SLACK * rest[who[late], b] * self.left[row[late], b] >= limits[who[late], 0]
                who, row, score = who[able], row[able], score[able]
        over = score >= exact[who]
        return who[over], self.order[row[over]], score[over].astype(np.int64)


#: Norms are rounded; bounds made of them are raised by this factor.
SLACK = 1.0 + 1e-9


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """n x (d + 1): the norm of each row's dimensions from k on."""
    squares = x.astype(float) ** 2
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - start < k]


def _block_join(wanted: DataFrame, rows: DataFrame, k: int, same: bool, most_squared: int, sizes: tuple[int, int]) -> DataFrame:
    """(anchor_row, w, vec_id, score): per block of rows the first k of every window [t, top]."""
    row_blocks, anchor_blocks = sizes

    def join(left, right):
        import pyarrow as pa

        out = {"anchor_row": [], "w": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            kind = exact_kind(most_squared)
            q, y = _matrix(left.column("x"), kind), _matrix(right.column("x"), kind)
            t, top, w = (left.column(c).to_pylist() for c in ("t", "top", "w"))
            limits = np.array([min(v) for v in t], np.int64)
            norms = np.sqrt((q.astype(float) ** 2).sum(1))
            relative = np.where(norms > 0, limits / np.maximum(norms, 1e-300), np.where(limits > 0, np.inf, 0.0))
            index = Index(y, float(relative.min()))
            anchor_label, row_label = left.column("label").to_numpy(), right.column("label").to_numpy()
            ids = right.column("vec_id").combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            order_id, anchor_id = ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False), left.column("vec_id").to_numpy()
            by = np.argsort(-relative, kind="stable")
            for a in range(0, len(by), STRIP):
                strip = by[a : a + STRIP]
                who, row, score = index.reaching(q[strip], limits[strip])
                who = strip[who]
                fits = (anchor_label[who] == row_label[row]) == same
                fits &= ~(known[row] & (order_id[row] == anchor_id[who]))
                who, row, score = who[fits], row[fits], score[fits]
                for slot in range(max(len(w[i]) for i in strip)):
                    has = np.array([slot < len(v) for v in w])
                    lo, hi = (np.array([v[slot] if slot < len(v) else 0 for v in of], np.int64) for of in (t, top))
                    inside = np.nonzero(has[who] & (score >= lo[who]) & (score <= hi[who]))[0]
                    best = inside[first_of_each(who[inside], score[inside], order_id[row[inside]], k)]
                    out["anchor_row"].append(left.column("anchor_row").to_numpy()[who[best]])
                    out["w"].append(np.array([w[i][slot] for i in who[best]], np.int64))
                    out["vec_id"].append(ids.take(pa.array(row[best])))
                    out["score"].append(score[best])
        ints = {c: pa.chunked_array([pa.array(v, pa.int64()) for v in out[c]], pa.int64()) for c in out}
        return pa.table(ints)

    each = wanted.groupBy("anchor_row").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("x").alias("x"),
        F.array_sort(F.collect_list(F.struct("w", "t", "top"))).alias("windows"),
    )
    each = each.select("anchor_row", "vec_id", "label", "x", *[F.col("windows").getField(c).alias(c) for c in ("w", "t", "top")])

    def dealt(rows: DataFrame, key: str, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(names[0])
        return rows.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]))

    left = dealt(each, "anchor_row", anchor_blocks, row_blocks, ("q", "r")).groupBy("q", "r")
    right = dealt(rows.select("row_no", "vec_id", "label", "x"), "row_no", row_blocks, anchor_blocks, ("r", "q")).groupBy("q", "r")
    return left.cogroup(right).applyInArrow(join, "anchor_row long, w long, vec_id long, score long")


def first_in_windows(wanted: DataFrame, rows: DataFrame, k: int, same: bool, thresholds: list[Callable[[], Column]]) -> DataFrame:
    """(anchor_row, w, vec_id, score, rank): the first ``k`` rows of every window.

    ``wanted``: anchor_row, vec_id, label, x, self, w, lo, hi.  Each round takes
    the next threshold, never under lo; the last round goes down to lo.
    """
    wanted = materialize(wanted.filter("lo <= hi").withColumn("top", F.col("hi")), "negatives-open")
    n, most = rows.agg(F.count("*"), F.max("self")).first()
    best = None
    for threshold in [*thresholds, lambda: F.col("lo")]:
        anchors = wanted.select(F.count_distinct("anchor_row")).first()[0]
        if best is not None and not anchors:
            break
        sizes = max(1, -(-n // BLOCK_ROWS)), max(1, -(-anchors // BLOCK_ANCHORS))
        now = wanted.withColumn("t", F.greatest("lo", F.least("top", threshold().cast("long"))))
        hits = _block_join(now, rows, k, same, most or 0, sizes)
        both = hits if best is None else hits.unionByName(best.drop("rank"))
        order = Window.partitionBy("anchor_row", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        best = materialize(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives-found")
        filled = best.filter(F.col("rank") == k).select("anchor_row", "w")
        # What reaches t has been found; the next round looks below it.
        wanted = materialize(now.filter("t > lo").join(filled, ["anchor_row", "w"], "left_anti").withColumn("top", F.col("t") - 1).drop("t"), "negatives-open")
    return best


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, label, embedding.  Per row for which ``anchors`` holds
    and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of another label that score from ``low`` to ``high``
    percent of the positive.
    """
    rows = integer_rows(vectors)
    chosen = rows.filter(F.col("vec_id").isNotNull() & anchors).withColumnRenamed("row_no", "anchor_row")
    everything = chosen.withColumn("w", F.lit(0).cast("long")).withColumn("lo", F.lit(-FAR)).withColumn("hi", F.lit(FAR))
    shares = [lambda s=s: F.ceil(F.col("self") * s) for s in (0.7, 0.35, 0.175)]
    good = first_in_windows(everything, rows, positives, True, shares).select("anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("w"))
    # Positives of one score share a window, named by the score.
    wide = F.col("w").cast("decimal(20,0)")
    windows = chosen.join(good.select("anchor_row", "w").distinct(), "anchor_row").withColumn("lo", F.ceil(wide * low / 100).cast("long")).withColumn("hi", F.floor(wide * high / 100).cast("long"))
    shares = [lambda s=s: F.col("lo") + F.ceil((F.col("hi") - F.col("lo")) * s) for s in (0.75, 0.4)]
    bad = first_in_windows(windows, rows, negatives, False, shares).select("anchor_row", "w", F.col("vec_id").alias("negative_id"), "score", "rank")
    return good.join(bad, ["anchor_row", "w"]).join(chosen.select("anchor_row", F.col("vec_id").alias("anchor_id")), "anchor_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("w").alias("positive_score"), F.col("score").alias("negative_score")
    )
