"""Exact duplicates, whitening and hard negatives, each against a plain version."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from footfall.llm import exact_dedup, hard_negatives, whitening
from footfall.llm.queries import op11_whitening
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int, n long, keep string"


# ------------------------------------------------------------------ exact duplicates
def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = sorted((i for i in ids if i is not None), reverse=True)
        ranked = known + [None] * (len(ids) - len(known))
        out += [(i, ranked[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ranked)]
    return Counter(out)


@pytest.mark.parametrize("counters", [3, 4095])
def test_exact_groups_equal_plain(spark, counters):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 8 + ["warm"] * 3 + [f"t{rng.randrange(40)}", None, "", " ", "x" * 5000])) for i in range(600)]
    rows += [(7, "hot"), (7, "hot"), (10_000, "hot"), (10_000, "hot"), (None, "hot"), (None, "alone"), (None, "Alone"), (3, "é"), (4, "é")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{DOCS}, n long, keep_id long").repartition(5)
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(table, counters).collect())
    assert got == plain_exact(rows)
    left = exact_dedup.keep_one_of_each(table, counters)
    assert left.columns == table.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((k, t or "") for (k, t) in {(max((i for i, x in rows if (x or "") == (t or "") and i is not None), default=None), t or "") for _, t in rows})
    assert exact_dedup.exact_groups(table.limit(0)).count() == 0 and exact_dedup.keep_one_of_each(table.limit(0)).count() == 0


def test_frequent_digests_are_found_and_few(spark):
    """Every digest over 2 / (k + 1) of the rows is found, with exact figures, and at most k + 1 are."""
    k, rows = 9, [(i, ("a" if i % 3 == 0 else "b" if i % 5 < 2 else f"u{i}").encode(), i) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, digest binary, row_no long").repartition(6)
    got = {bytes(r.digest): (r.n, r.keep.doc_id) for r in exact_dedup.frequent_digests(table, k).collect()}
    count = Counter(d for _, d, _ in rows)
    assert len(got) <= k + 1 and {d for d, n in count.items() if n > 2 * len(rows) / (k + 1)} <= set(got)
    assert all(got[d] == (count[d], max(i for i, x, _ in rows if x == d)) for d in got)


# ------------------------------------------------------------------ whitening
def usable(rows, scale, offset):
    out = []
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(math.floor(scale * float(np.float32(c))) + offset for c in v)))
    return out


def check_whitening(got, rows, components=16):
    rows = usable(rows, 64, 1_000_000)
    fit = sorted({x for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = {x: [n * c - s for c, s in zip(x, sums)] for x in fit}
    y = np.array([[c / n for c in dev[x]] for x in fit])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in rows for c in range(1, k + 1))
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.deviation, r.component].append(r)  # a repeated id's rows are told apart by their vector
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) <= 1e-9 and len({r.identity_error for r in got}) == 1
    for c in range(1, k + 1):
        own = np.array([by[i, sum(v * v for v in dev[x]), c].pop().whitened for i, x in rows])
        want = np.array([[v / n for v in dev[x]] for _, x in rows]) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-7
    share = {r.component: r.explained for r in got}
    assert all(abs(share[c] - values[c - 1] / np.trace(cov)) < 1e-9 for c in share)
    assert {(r.vec_id, r.deviation) for r in got} == {(i, sum(v * v for v in dev[x])) for i, x in rows}


def vectors(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 0, 9, "x") for i, v in rows], VECTORS).repartition(parts)


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(300, 20)) @ np.diag(2.0 ** -np.arange(20)) * 30 + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(150)] + [(None, hot), (7, rows[7][1]), (7, rows[8][1])]
    bad = [(2000, None), (2001, [None, *hot[1:]]), (2002, [float("nan"), *hot[1:]]), (2003, [float("inf"), *hot[1:]]), (2004, []), (2005, hot[:5]), (2006, [1e30, *hot[1:]])]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    check_whitening(got, rows)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(op11_whitening(spark, SMALL).collect(), rows)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows, 1)).count() == 0
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(6)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and {round(r.explained, 9) for r in got} == {1.0}


def test_jacobi_on_the_factor_keeps_small_eigenvalues():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    want = 10.0 ** -np.arange(9)
    scatter = q @ np.diag(want) @ q.T
    factor = whitening.pivoted_cholesky(scatter)
    assert np.allclose(factor @ factor.T, scatter, atol=1e-15)
    values, axes = whitening.principal_axes(scatter, 1)
    assert np.allclose(values, want, rtol=1e-6) and np.allclose(axes.T @ axes, np.eye(9), atol=1e-12)


def test_exact_numbers_beyond_longs():
    x = np.array([[2**40, 5], [0, -7]])
    dev = whitening.deviations(x, 2**30, [2**70, 3])
    assert dev.tolist() == [[2**70 - 2**70, 5 * 2**30 - 3], [-(2**70), -7 * 2**30 - 3]]
    assert whitening.squared_length(dev) == [(5 * 2**30 - 3) ** 2 if (5 * 2**30 - 3) ** 2 < 2**63 else None, None]


# ------------------------------------------------------------------ hard negatives
def plain_negatives(rows, every, positives=5, negatives=3):
    """rows: (vec_id, vector, label), usable or not."""
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v], g) for i, v, g in rows if g is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, x, g in ok:
        if i is None or i % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(x, y)), j, h) for j, y, h in ok if j != i), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, _ in [s for s in scored if s[2] == g][:positives]:
            fits = [s for s in scored if s[2] != g and 50 * p <= 100 * s[0] <= 95 * p][:negatives]
            out += [(i, j, k + 1, m, p, s) for k, (s, m, _) in enumerate(fits)]
    return Counter(out)


def cases(n, d, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.normal(size=d) / math.sqrt(d)], int(rng.integers(3))) for i in range(n)]
    centre = rows[0][1]
    rows += [(1000 + i, centre, i % 4) for i in range(60)]  # one vector many times, in several labels
    rows += [(2000 + i, [c * (1 + i / 50) for c in centre], 1) for i in range(40)]
    rows += [(None, centre, 0), (30, centre, 1), (3000, [0.0] * d, 0), (3010, [-c for c in centre], 2), (3020, None, 1), (3030, [None] * d, 1), (3040, [float("nan")] * d, 1), (3050, centre, None), (3060, centre[:2], 1), (3070, [], 1), (3080, [3e9] * d, 1)]
    return rows


@pytest.mark.parametrize("block", [None, 37])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
        monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 5)
    rows = cases(250, 24, 1)
    table = spark.createDataFrame([(i, v, g, 1, "k") for i, v, g in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 10 == 0)
    usable_rows = [r for r in rows if r[0] not in (3060, 3080)]
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives(usable_rows, 10)


def test_negatives_of_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, [0.0], 1), (1, [1.0], 1), (2, [0.5], 2)]):
        table = spark.createDataFrame([(i, v, g, 1, "k") for i, v, g in rows], VECTORS)
        assert Counter(tuple(r) for r in hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0).collect()) == plain_negatives(rows, 50)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_index_reaches_all_pairs_over_the_limit(kind):
    rng = np.random.default_rng(4)
    scale = 90 if kind == np.float32 else 10**5 if kind == np.float64 else 10**8
    rows, anchors = (np.floor(rng.normal(size=(n, 24)) * scale * 0.9 ** np.arange(24)).astype(kind) for n in (400, 30))
    full = anchors.astype(np.int64) @ rows.astype(np.int64).T
    for share in (0.8, 0.5, 0.1, 0.0, -1.0):
        limits = (share * (anchors.astype(np.int64) ** 2).sum(1)).astype(np.int64)
        theta = float((limits / np.sqrt((anchors.astype(float) ** 2).sum(1))).min())
        index = hard_negatives.Index(rows, theta)
        who, row, score = index.reaching(anchors, limits)
        assert sorted(zip(who.tolist(), row.tolist(), score.tolist())) == sorted((a, b, int(full[a, b])) for a, b in zip(*np.nonzero(full >= limits[:, None])))
        if share == 0.8:
            assert (index.ends < 24).any()
