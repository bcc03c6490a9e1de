"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from footfall.session import materialize, scratch_path  # noqa: F401

#: ASCII white space: 0x20 and 0x09-0x0D, as a regex class body and as a plain string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (task functions
    travel by value, so their own globals last for one task only)."""
    name = "_footfall_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def row_groups(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [a, b) of at most ``budget`` bytes (one row at least)."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield a, b
        a = b


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (null: empty) and its n + 1 offsets, without a copy."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data, offsets


#: What the span finders return per document: spans by start, then by kind as listed.
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"


def span_report(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Digest columns of a span finder's result: counts and hash of the base spans, all spans as text."""
    from pyspark.sql import functions as F

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def let(value, body):
    """``body`` of a lambda variable that is bound to ``value`` (inside another lambda an expression would be worked out per element)."""
    from pyspark.sql import functions as F

    return F.transform(F.array(value), body)[0]
