"""Shape of the physical plans: pushdown reaches the scan, top-k uses the
window-group limit, and no operator falls back to a nested-loop or
cartesian join."""

import __spark_entry__ as E


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_filter_reaches_parquet_scan(spark, small_dir):
    p = plan(E.queries()["filter_points"](spark, small_dir))
    assert "PushedFilters" in p and "GreaterThanOrEqual(l_quantity" in p


def test_topk_uses_window_group_limit(spark, small_dir):
    assert "WindowGroupLimit" in plan(E.queries()["adjacency_topk"](spark, small_dir))


def test_no_nested_loop_or_cartesian_joins(spark, small_dir):
    for name in ("score_content", "historical_baseline", "optout_purge", "asof_geo",
                 "consent_filter", "funnel", "lookalike", "cluster_detections"):
        p = plan(E.queries()[name](spark, small_dir))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_column_pruning_on_events_scan(spark, small_dir):
    p = plan(E.queries()["frame_rate"](spark, small_dir))
    # frame rate needs only the key, the time and the id: value and props are never read
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p
