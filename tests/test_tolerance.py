"""Malformed values, white space, rounding order, masking and plan shapes."""

import pytest
from footfall.operators import classify, governance, graph
from pyspark.sql import functions as F

from util import ts


def test_malformed_amounts_become_null(spark):
    df = spark.createDataFrame([("a", "u", ts(0), "purchase", {"amount": "12.50 USD", "item_count": "two"}), ("b", "u", ts(1), "purchase", {"amount": "12.50", "item_count": "2"})],
                               "event_id string, uuid string, ts timestamp, event_type string, context map<string,string>")
    got = {r.event_id: (r.amount, r.item_count) for r in classify.purchase_facts(df).collect()}
    assert got == {"a": (None, None), "b": (12.5, 2)}


def test_blank_queries_of_any_white_space(spark):
    df = spark.createDataFrame([("\t\n", "submit"), ("﻿  ", "submit"), ("\t jazz\n", "submit"), (" \tab\n", "input")], "query_text string, action string")
    assert [(r.search_type, r.search_query) for r in classify.search_events(df).collect()] == [("search", "jazz")]


def test_typed_and_linked_text_is_masked(spark):
    df = spark.createDataFrame([("search_input", {"search_partial": "my name", "n": "1"}), ("download", {"link_text": "mail me a@b.com"})], "event_type string, context map<string,string>")
    a, b = [r.context for r in governance.redact_pii(df).collect()]
    assert a["search_partial"].startswith("q:") and "n" not in a and b["link_text"] == "mail me [email]"


def test_dedup_plan_and_rule(spark):
    df = spark.createDataFrame([("a", ts(5), 1), ("a", ts(3), 2), ("a", ts(3), 3), ("b", ts(1), 4)], "event_id string, ingest_ts timestamp, x int")
    out = governance.dedup(df)
    assert sorted((r.event_id, r.x) for r in out.collect()) == [("a", 2), ("b", 4)] and out.columns == df.columns
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan


def test_funnel_reads_the_events_once_per_step(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet").select(F.col("user_id").cast("string").alias("uuid"), "ts", "event_type")
    steps = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").limit(4).collect()]
    plan = graph.funnel(events, steps)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= len(steps)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from footfall.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
