"""Upload batches in, canonical envelopes out — including the three
assertions the client migration guide makes (initialisation, venue view
shape, offline delivery)."""

import json

from pyspark.sql import functions as F

from footfall.operators import envelope as EV
from footfall.operators import reports as RP
from footfall.sources import uploads as UP


def batch(events, client="test-client-id", **extra):
    return json.dumps({"client_id": client, "events": events, **extra})


def test_upload_batch_parse_fill_and_quarantine(spark):
    lines = [
        batch([{"event_id": "e1", "event_type": "view_venue", "timestamp": "2024-01-01T10:00:00.000Z",
                "anon_user_id": "anon-legacy", "context": {"venue_id": "venue_123", "name": "Test Venue",
                                                           "tags": ["music", "jazz"]}}]),
        batch([{"event_id": "e2", "event_type": "impression", "timestamp": "1704103200.5", "uuid": "billboard-1",
                "platform": "ios", "geo_context": {"latitude": 40.7, "longitude": -74.0}}], device_id="dev-9"),
        "{not json",
    ]
    text = spark.createDataFrame([(x,) for x in lines], "value string")
    raw = UP.parse_upload_batches(text)
    env = {r["event_id"]: r for r in EV.normalize_envelope(raw).collect()}
    # 1. initialisation: client id reaches every event, the user id is set (legacy field renamed)
    assert env["e1"]["client_id"] == "test-client-id" and env["e1"]["uuid"] == "anon-legacy"
    # 2. venue view: type and venue id kept; entity id taken from the venue id
    assert env["e1"]["event_type"] == "view_venue"
    assert env["e1"]["context"]["venue_id"] == "venue_123" and env["e1"]["entity_id"] == "venue_123"
    assert env["e1"]["context"]["tags"] == '["music","jazz"]'
    # batch-level device id fills the event; iOS epoch seconds and geo_context are understood
    assert env["e2"]["device_id"] == "dev-9"
    assert env["e2"]["geo"]["lat"] == 40.7
    assert env["e2"]["ts"].isoformat().startswith("2024-01-01T10:00:00.5")
    assert UP.quarantine_batches(text).count() == 1


def test_offline_events_are_delivered_late_not_lost(spark):
    # 3. offline: queued events arrive later with their original time; they are kept and counted as late
    rows = [("e1", "web", "2024-01-01 10:00:00", "2024-01-01 10:00:01"),
            ("e2", "web", "2024-01-01 10:00:05", "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "event_id string, platform string, ts string, ingest_ts string") \
        .select("event_id", "platform", F.to_timestamp("ts").alias("ts"), F.to_timestamp("ingest_ts").alias("ingest_ts"))
    lag = RP.delivery_lag(df, late_after_s=60).first()
    assert lag["events"] == 2 and lag["late_share"] == 0.5


def test_export_batches_at_most_n_fifo(spark):
    # an event every ten minutes: batches must run on over hours
    rows = [("c", f"e{i:03d}", i * 600, "u") for i in range(120)] + [("c", f"x{i}", i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "client_id string, event_id string, s long, uuid string").withColumn("ts", F.timestamp_seconds("s"))
    b = UP.export_batches(df.drop("s"), n=50).orderBy(F.col("queue").desc_nulls_last(), "batch_no").collect()
    assert [r["n_events"] for r in b] == [50, 50, 20, 3]
    first = json.loads(b[0]["payload"])
    assert first["client_id"] == "c" and [e["event_id"] for e in first["events"]][:3] == ["e000", "e001", "e002"]


def test_stream_upload_batches_file_source(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(batch([{"event_id": "s1", "event_type": "search", "timestamp": "2024-01-01T00:00:00Z"},
                                       {"event_id": "s2", "event_type": "share", "timestamp": "2024-01-01T00:00:01Z"}])
                                + "\n" + "garbage\n")
    (src / "b.json").write_text(batch([{"event_id": "s3", "event_type": "favorite",
                                        "timestamp": "2024-01-01T00:00:02Z"}], client="c2") + "\n")
    stream = UP.stream_upload_batches(spark, str(src), max_files_per_trigger=1)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["event_id"], r["client_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("s1", "test-client-id"), ("s2", "test-client-id"), ("s3", "c2")}
