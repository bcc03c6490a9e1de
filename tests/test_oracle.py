"""Registered queries against their independent DuckDB oracle on the
sf0.001 tables (one or more per operator family; the full list runs with
``python tools/oracle_check.py``)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.util import same_rows

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

NAMES = [
    "adjacency_topk", "ttl_live", "consent_filter", "optout_purge", "dedup_events", "privacy_retention",
    "asof_geo", "asof_content", "thin_locations", "session_summary", "play_intervals", "event_cube",
    "search_ctr", "cluster_detections", "frame_metrics", "context_aggregate", "history_short",
    "historical_baseline", "select_content", "classify_click", "scroll_milestones", "normalize_envelope",
    "canonical_type", "funnel", "attribution_last_touch", "stream_recent_context", "stream_sessions",
]


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{small_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, small_dir, name):
    df = E.queries()[name](spark, small_dir)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    s = [tuple(r[df.columns.index(c)] for c in order) for r in srows]
    d = [tuple(r[dcols.index(c)] for c in order) for r in drows]
    assert same_rows(s, d)


def test_every_query_has_a_callable_and_most_an_oracle():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100
    from footfall.plans import load_all

    # Of the library's own plans; other packages may register queries beside them.
    assert len(set(load_all()) - set(sqls)) <= 3


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["uuid", "rank", "relation", "target", "weight"]
    assert df.count() > 0
