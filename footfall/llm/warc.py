"""Web archives, index first.

Writing gives WARC 1.1 files (a gzip member per record) in a shared folder and
an index row per record: file, offset, length, URL and payload digest.
Reading starts from the index: the selected rows are sorted by file and
offset, neighbouring byte ranges are joined into one read, and each record is
unpacked from its range and checked against its digest.

Of records with equal payloads the one with the smallest page_id is a
``response``; the others are ``revisit`` records that name it and carry no
payload.  Files go to a folder that all executors share, by any file system
that Arrow knows; a task that is run again writes new files, and only those
named in the index are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize, scratch_path

#: Pages carry no time of their own.
RECORD_DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
#: Ranges this close are read at once, up to so many bytes; bytes of archive for a reading task.
NEAR_BYTES, READ_BYTES, TASK_BYTES = 64 << 10, 4 << 20, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "path string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {RECORD_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url)
        head.append(f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; ``payload`` is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or sha1_base32(payload) != digest:
            raise ValueError("a record's payload does not agree with its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"),
    }


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def first_of_equal(pages: DataFrame) -> DataFrame:
    """``pages`` as page_id, url, payload (binary) and ``first``, the smallest page_id with an equal payload."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    # Counts only; a payload held by a third of all pages is combined before the shuffle,
    # and the join on it may be split, as nothing above it needs a digest's rows together.
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    return rows.join(firsts, "sha").select("page_id", "url", "payload", "first")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Archives ``pages`` (page_id, url, html; null html: empty) below ``folder``; returns the index.

    A row with a null page_id is a revisit if its payload has a page with an
    id, else a response.  Rows that repeat a page_id with the same payload are
    all responses or all revisits.  Other columns are ignored.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                digest = sha1_base32(payload)
                refers_to = None if first is None or first == page_id else first
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = deflate.compress(record(page_id, url, payload, digest, refers_to)) + deflate.flush()
                out.write(data)
                rows.append((name, at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(data)
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return first_of_equal(pages).mapInArrow(run, INDEX)


def joined_ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """(path, start, end, first row, last row + 1) of reads that cover ``rows`` (path, offset, length), sorted."""
    out: list[list] = []
    for i, (path, offset, length) in enumerate(rows):
        last = out[-1] if out else None
        if last and last[0] == path and offset - last[2] <= NEAR_BYTES and offset + length - last[1] <= READ_BYTES:
            last[2], last[4] = max(last[2], offset + length), i + 1
        else:
            out.append([path, offset, offset + length, i, i + 1])
    return [tuple(x) for x in out]


def read_warc(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the selected rows of an index (given as a written table), a row each.

    Payloads are always read and checked; without ``payloads`` they stay in the task.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / TASK_BYTES))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for path, start, end, a, b in joined_ranges(rows):
                with store.open_input_file(f"{base}/{path}") as f:
                    data = f.read_at(end - start, start)
                found = [parse_record(zlib.decompress(data[o - start : o - start + n], 47)) for _, o, n in rows[a:b]]
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, kinds)], names)

    rows = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads all records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(materialize(write_warc(pages, folder), "warc-index"), folder, payloads)
