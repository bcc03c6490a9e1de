"""Hyperplane signatures beside the exact lookalike: recall, and the edge cases of the index."""

import random

from pyspark.sql import functions as F

from footfall.operators import graph as G
from footfall.session import scratch_path


def interest_rows(users, categories, rnd):
    for u in range(users):
        mix = [rnd.random() ** 4 + 1e-3 for _ in range(categories)]
        for c, x in enumerate(mix):
            yield f"u{u}", f"cat{c}", x / sum(mix)


def test_recall_and_selectivity(spark):
    """Over 2 seed groups of 4,000 users in 12 categories: at least 0.9 of the exact top 10 comes back, and the
    candidates are a part of the users only."""
    rnd = random.Random(4)
    scores = spark.createDataFrame(list(interest_rows(4000, 12, rnd)), "uuid string, category string, score double").cache()
    index = G.signature_index(G.category_signatures(scores), scratch_path(spark, "signatures"))
    found, wanted = 0, 0
    for _ in range(2):
        seeds = spark.createDataFrame([(f"u{rnd.randrange(4000)}",) for _ in range(3)], "uuid string")
        exact = {r["uuid"]: r["similarity"] for r in G.lookalike(scores, seeds, 10).collect()}
        got = {r["uuid"]: r["similarity"] for r in G.lookalike_by_signature(scores, seeds, index, 10).collect()}
        found += len(exact.keys() & got.keys())
        wanted += len(exact)
        assert all(abs(got[u] - exact[u]) < 1e-9 for u in got.keys() & exact.keys())
    assert found / wanted >= 0.9
    bands = index.groupBy("band_key").count().agg(F.max("count")).first()[0]
    assert bands < 4000 / 4


def test_same_vector_same_bands_and_edges(spark):
    scores = spark.createDataFrame(
        [("a", "x", 0.5), ("a", "y", 0.5), ("b", "y", 0.25), ("b", "x", 0.25), ("n", None, 1.0), ("z", "x", None)],
        "uuid string, category string, score double")
    sig = {r["uuid"]: r["bands"] for r in G.category_signatures(scores).collect()}
    assert sig["a"] == sig["b"] and len(sig["a"]) == G.SIGNATURE_BANDS
    assert sig["n"] != sig["a"]
    assert all(b >> G.BAND_BITS == i for s in sig.values() for i, b in enumerate(s))
    index = G.signature_index(G.category_signatures(scores), scratch_path(spark, "signatures"))
    assert index.count() == len(sig) * G.SIGNATURE_BANDS
    seeds = spark.createDataFrame([("a",)], "uuid string")
    assert [r["uuid"] for r in G.lookalike_by_signature(scores, seeds, index, 1).collect()] == ["b"]
    none = spark.createDataFrame([("nobody",)], "uuid string")
    assert G.lookalike_by_signature(scores, none, index, 5).where("similarity is not null").count() == 0
