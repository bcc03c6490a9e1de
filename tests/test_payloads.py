"""Payload keys as the clients send them, and rules at their edges."""

import datetime as dt

import pytest

from footfall.operators import classify as CL
from footfall.operators import envelope as EV
from footfall.operators import sessions as SS


def ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def event(spark, kind, context):
    return spark.createDataFrame([("e1", kind, context)], "event_id string, event_type string, context map<string,string>")


def test_typed_view_reads_client_keys_and_survives_bad_values(spark):
    sent = {"content_id": "c1", "content_name": "Ad", "planned_duration": "15000", "actual_duration": "soon", "completion_rate": "0.5"}
    row = EV.typed_view(event(spark, "content_end", sent), "content_end").first()
    assert (row.content_id, row.content_name, row.planned_duration, row.actual_duration, row.completion_rate) == ("c1", "Ad", 15000, None, 0.5)


@pytest.mark.parametrize("key", ["content_duration", "duration_ms"])
def test_impression_duration_under_either_key(spark, key):
    row = EV.typed_view(event(spark, "impression", {"content_id": "c1", key: "9000"}), "impression").first()
    assert row.content_duration == 9000


def test_search_filters_nested_or_flat(spark):
    rows = [(0, {"filters": '{"location":"nyc","date":""}', "category": "music"}),
            (1, {"location": "nyc", "date": "today"}),
            (2, {"filters": "not json"}),
            (3, {"category": "false"}),
            (4, None)]
    df = spark.createDataFrame(rows, "i int, context map<string,string>")
    got = {r.i: (r.has_location_filter, r.has_date_filter, r.has_category_filter) for r in CL.search_flags(df).collect()}
    assert got == {0: (True, False, False), 1: (True, True, False), 2: (False,) * 3, 3: (False,) * 3, 4: (False,) * 3}


def test_session_ends_at_exactly_the_gap(spark):
    rows = [("u", "a", ts(0)), ("u", "b", ts(1799)), ("u", "c", ts(1799 + 1800))]
    df = spark.createDataFrame(rows, "uuid string, event_id string, ts timestamp")
    got = {r.event_id: r.is_session_start for r in SS.sessionize(df, 1800).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_half_ewma_keeps_what_is_far_back(spark):
    n = 400
    rows = [("k", i, ts(i), 1.0 if i == 0 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, i long, ts timestamp, v double")
    want = {i: 2.0 ** -(i + 1) for i in range(n)}
    assert {r.i: r.half_ewma for r in SS.half_ewma(df, "key", ["ts", "i"], "v").collect()} == want
    assert SS.last_half_ewma(df, "key", ["ts", "i"], "v").first().half_ewma == want[n - 1]


def test_half_ewma_over_small_chunks(spark):
    n = 64 * 80
    rows = [("k", i, ts(i), float(i % 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, i long, ts timestamp, v double")
    got = {r.i: r.half_ewma for r in SS.half_ewma(df, "key", ["ts", "i"], "v", chunk_rows=1).collect()}
    a = 0.0
    for i in range(n):
        a = (a + i % 13) / 2
        assert got[i] == pytest.approx(a, rel=1e-12)


def test_page_from_the_keys_of_page_views(spark):
    rows = [("s", "u", "a", ts(0), "view_content", "web", "x", {"url": "/home"}),
            ("s", "u", "b", ts(1), "view_content", "web", "x", {"path": "/end"})]
    df = spark.createDataFrame(rows, "session_id string, uuid string, event_id string, ts timestamp, event_type string, "
                                     "platform string, entity_id string, context map<string,string>")
    row = SS.session_summary(df).first()
    assert (row.entry_page, row.exit_page) == ("/home", "/end")
