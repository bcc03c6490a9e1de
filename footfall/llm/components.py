"""Connected components by alternating star contractions, on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize


def _to_least(pairs: DataFrame, with_self: bool) -> DataFrame:
    """For each u of the pairs (u, v): every v, linked to the least of u and its v's.

    The least neighbour is an aggregate and a join on u, so a node with very
    many neighbours is combined before the shuffle and may be split in the join.
    """
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    out = pairs.join(least, "u").select("v", "m")
    if with_self:
        out = out.unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b: long): the smallest id reachable.

    Each round rewrites the edges twice and writes them to the shared folder;
    it ends when a round changes nothing, and then every node is linked to its
    component's least node.  Self links and repeats do no harm; no edges give
    no rows.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "cc")
    before = _state(edges)
    while before.n:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Large star: larger neighbours move to the least one. Small star: smaller ones and the node itself do.
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialize(_to_least(large, True), "cc")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
