"""Upload batches in, event store out.

* S1 ``read_upload_batches`` — JSON files of ``{client_id, device_id?,
  location_id?, events[]}``; one output row per event; batch keys fill the
  event's missing keys; malformed records are kept apart (quarantine).
* S2 ``stream_upload_batches`` — the same over a file stream.
* S3 ``read_events_parquet`` — columnar event store scan, pruned by the
  ``event_date`` / ``event_type`` folder partitions.
* S4 ``write_events`` — append-only store partitioned by date and type;
  stream sink is idempotent by micro-batch id.
* S5 ``export_batches`` — regroup events into upload-shaped batches of at
  most ``n`` events, FIFO per client and user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.sources.schema import RAW_EVENT, UPLOAD_BATCH

CORRUPT = "_corrupt_record"
#: When a batch was received: it comes with the batch (a column, or the time the file was written), so reading it again gives the same rows.
RECEIVED = "received_at"


def _flatten_batches(batches: DataFrame) -> DataFrame:
    """One row per event; batch-level keys fill the event's missing ones."""
    ev = batches.select(
        F.col("client_id").alias("_b_client"),
        F.col("device_id").alias("_b_device"),
        F.col("location_id").alias("_b_location"),
        F.explode("events").alias("e"),
        *([F.col(RECEIVED)] if RECEIVED in batches.columns else []),
    )
    cols = [F.col(RECEIVED)] if RECEIVED in batches.columns else []
    for f in RAW_EVENT.fieldNames():
        c = F.col(f"e.{f}")
        if f == "client_id":
            c = F.coalesce(c, F.col("_b_client"))
        elif f == "device_id":
            c = F.coalesce(c, F.col("_b_device"))
        elif f == "location_id":
            c = F.coalesce(c, F.col("_b_location"))
        cols.append(c.alias(f))
    return ev.select(*cols)


def parse_upload_batches(df: DataFrame, col: str = "value") -> DataFrame:
    """Parse a column of upload-batch JSON text into raw event rows; a
    ``received_at`` column of ``df`` goes to every event of the batch.

    Adds no rows for malformed text; use :func:`quarantine_batches` to
    keep those records."""
    with_time = [F.col(RECEIVED)] if RECEIVED in df.columns else []
    parsed = df.select(F.from_json(F.col(col), UPLOAD_BATCH).alias("b"), *with_time).select("b.*", *with_time)
    return _flatten_batches(parsed.where(F.col("events").isNotNull()))


def quarantine_batches(df: DataFrame, col: str = "value") -> DataFrame:
    """Records whose text is not an upload batch (or has no events array),
    with their ``received_at`` if ``df`` has it."""
    with_time = [F.col(RECEIVED)] if RECEIVED in df.columns else []
    parsed = df.select(F.col(col).alias(CORRUPT), F.from_json(F.col(col), UPLOAD_BATCH).alias("b"), *with_time)
    return parsed.where(F.col("b").isNull() | F.col("b.events").isNull()).select(CORRUPT, *with_time)


def _written_at():
    return F.col("_metadata.file_modification_time").alias(RECEIVED)


def read_upload_batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) from line-delimited JSON upload batches.

    ``received_at`` is the time the file was written.  The quarantine holds
    the text of every line that is no batch, or has no events array, so that
    both sides together are all lines."""
    text = spark.read.text(path).select("value", _written_at())
    return parse_upload_batches(text), quarantine_batches(text)


def stream_upload_text(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The lines of an upload folder as a stream: ``value``, ``received_at``."""
    return spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path).select("value", _written_at())


def stream_upload_batches(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Continuous variant (file source), good events only; to keep the
    malformed lines too, write :func:`stream_upload_text` with
    :func:`route_uploads`."""
    return parse_upload_batches(stream_upload_text(spark, path, max_files_per_trigger), "value")


def route_uploads(events_path: str, rejects_path: str):
    """A ``foreachBatch`` function over upload lines with two sinks: raw
    events and rejected lines, each in the folder of its batch id.  A replayed
    micro-batch overwrites exactly its own two folders, so good and bad lines
    together stay all lines."""

    def _route(batch_df: DataFrame, batch_id: int) -> None:
        lines = batch_df.persist()
        parse_upload_batches(lines).write.mode("overwrite").parquet(f"{events_path.rstrip('/')}/batch_id={batch_id}")
        quarantine_batches(lines).write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/batch_id={batch_id}")
        lines.unpersist()

    return _route


def read_events_parquet(
    spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None,
    event_types: list[str] | None = None,
) -> DataFrame:
    """S3: scan the event store; the date/type predicates prune folders."""
    df = spark.read.parquet(path)
    if start_date is not None:
        df = df.where(F.col("event_date") >= F.lit(start_date).cast("date"))
    if end_date is not None:
        df = df.where(F.col("event_date") <= F.lit(end_date).cast("date"))
    if event_types:
        df = df.where(F.col("event_type").isin(list(event_types)))
    return df


def _with_event_date(df: DataFrame, ts_col: str) -> DataFrame:
    return df.withColumn("event_date", F.to_date(F.col(ts_col)))


def write_events(df: DataFrame, path: str, ts_col: str = "ts", max_records_per_file: int = 5_000_000) -> None:
    """S4 (batch): append, partitioned by ``event_date`` and ``event_type``.

    Rows are dealt by folder before the write, so a folder gets few files
    (not one of every task); the rebalance hint lets AQE cut a hot folder over
    many tasks and join small ones.  ``maxRecordsPerFile`` bounds file size."""
    (
        _with_event_date(df, ts_col)
        .hint("rebalance", F.col("event_date"), F.col("event_type"))
        .sortWithinPartitions("event_date", "event_type")
        .write.mode("append")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("event_date", "event_type")
        .parquet(path)
    )


def write_events_batch(path: str, ts_col: str = "ts"):
    """S4 (stream): a ``foreachBatch`` function that is idempotent by batch
    id — a replayed micro-batch overwrites exactly its own folder."""

    def _write(batch_df: DataFrame, batch_id: int) -> None:
        (
            _with_event_date(batch_df, ts_col)
            .sortWithinPartitions("event_date", "event_type")
            .write.mode("overwrite")
            .partitionBy("event_date", "event_type")
            .parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
        )

    return _write


def export_batches(
    df: DataFrame, n: int = 50, client_col: str = "client_id", ts_col: str = "ts", id_col: str = "event_id",
    queue_col: str = "uuid",
) -> DataFrame:
    """Regroup events into upload batches of at most ``n`` events, FIFO
    per queue.  A queue is one installation: the events of a user (or
    device, ``queue_col``) of a client; only its last batch can be short.

    Queue places come from ``global_row_number`` (counts per time bucket plus
    a carry-in), so a queue with very many events is still spread over many
    window partitions.  Each batch group holds at most ``n`` rows.  Rows with
    a null client or user form queues of their own."""
    from footfall.operators.asof import global_row_number

    def key(c):  # null-safe text: null and the empty text stay apart
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    # each event is rendered to JSON before grouping, so the batch list
    # sorts on (row number, text) — maps inside events need no ordering
    event_json = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != client_col]))
    rows = df.select(client_col, queue_col, ts_col, id_col, event_json.alias("_j"),
                     key(client_col).alias("_qc"), key(queue_col).alias("_qq"))
    numbered = global_row_number(rows, ["_qc", "_qq"], ts_col, [ts_col, id_col, "_j"]) \
        .withColumn("batch_no", F.floor((F.col("_rn") - 1) / F.lit(n)).cast("bigint"))
    grouped = numbered.groupBy(client_col, queue_col, "batch_no").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_rn"), F.col("_j").alias("j")))).alias("_items")
    )
    client_json = F.regexp_replace(F.to_json(F.struct(F.col(client_col).alias("c"))), r'^\{"c":|\}$', "")
    body = F.concat(F.lit('{"client_id":'), client_json, F.lit(',"events":['),
                    F.array_join(F.transform("_items", lambda x: x["j"]), ","), F.lit("]}"))
    return grouped.select(
        F.col(client_col).alias("client_id"),
        F.col(queue_col).alias("queue"),
        "batch_no",
        F.size("_items").alias("n_events"),
        body.alias("payload"),
    )
