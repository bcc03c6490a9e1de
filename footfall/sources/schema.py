"""Schemas fixed at ingest (the client payloads are schemaless JSON)."""

from __future__ import annotations

from pyspark.sql import types as T

# One raw event as any client dialect sends it.  Numbers that some dialects
# send as strings (Android) are read as STRING and cast during normalisation;
# ``timestamp`` is ISO text (JS, Android) or epoch seconds (iOS).
RAW_GEO = T.StructType([
    T.StructField("lat", T.StringType()),
    T.StructField("lng", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
    T.StructField("accuracy", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

RAW_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("uuid", T.StringType()),
    T.StructField("anon_user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("location_id", T.StringType()),
    T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geo", RAW_GEO),
    T.StructField("geo_context", RAW_GEO),
    T.StructField("tags", T.StringType()),
    T.StructField("ttl", T.IntegerType()),
])

UPLOAD_BATCH = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("location_id", T.StringType()),
    T.StructField("events", T.ArrayType(RAW_EVENT)),
])

GEO = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
])

# Canonical envelope (one fact row per event).
ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ingest_ts", T.TimestampType()),
    T.StructField("uuid", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("location_id", T.StringType()),
    T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geo", GEO),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("ttl", T.IntegerType()),
])
