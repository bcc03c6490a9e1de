"""Exact duplicates by a heavy-hitter split.

Texts are equal when their SHA-256 is.  The digests are written once with a
row number, so the texts are read a single time.  Every task then sums up its
digests in a Misra-Gries summary of at most ``COUNTERS`` counters.  A digest
of more than 2 / (COUNTERS + 1) of the rows is sure to be among those whose
counters add up to half of that, and there are never more than COUNTERS + 1 of
these.  Their exact sizes and winners (one aggregate, combined in every task)
are that small table, which is broadcast: rows of frequent digests are
settled where they lie, however large a group is.  All other digests take an
ordinary shuffle; none of their groups exceeds 2 / (COUNTERS + 1) of the rows.

Defined cases.  A null text counts as empty.  In every group exactly one row
stays: the one with the largest doc_id, the first written of several with that
id; a null id is smaller than any other.  Columns of any other name are left
alone by ``keep_one_of_each`` and unread by ``exact_groups``.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import materialize

#: Counters of one task's summary; the broadcast holds at most one row more.
COUNTERS = 4095


def summarise(batches: Iterator, counters: int) -> Iterator:
    """Misra-Gries over Arrow batches of one digest column: (digest, counter).

    A batch's counts are added to the counters; if more than ``counters``
    digests are left, the largest count that has no room is taken off all.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held = pa.table({"digest": pa.array([], pa.binary()), "counter": pa.array([], pa.int64())})
    for batch in batches:
        seen = batch.column(0).cast(pa.binary()).value_counts()
        new = pa.table({"digest": seen.field("values"), "counter": seen.field("counts")})
        held = pa.concat_tables([held, new]).group_by("digest").aggregate([("counter", "sum")]).rename_columns(["digest", "counter"])
        if held.num_rows > counters:
            over = pc.sort_indices(held.column("counter"), sort_keys=[("", "descending")])[counters]
            left = pc.subtract(held.column("counter"), held.column("counter")[over.as_py()])
            held = pa.table({"digest": held.column("digest"), "counter": left}).filter(pc.greater(left, 0))
    yield from held.combine_chunks().to_batches()


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n, keep) of every digest that may hold more than 2 / (counters + 1) of ``rows`` (digest, doc_id, row_no).

    n and keep (the staying row) are exact; at most counters + 1 rows come
    back, since the counters of all tasks together never exceed the rows.
    """
    least = rows.agg(F.floor(F.count("*") / (counters + 1)).alias("least"))
    sums = rows.select("digest").mapInArrow(lambda b: summarise(b, counters), "digest binary, counter long")
    often = sums.groupBy("digest").agg(F.sum("counter").alias("c")).filter(F.col("c") > least.scalar()).select("digest")
    return rows.join(F.broadcast(often), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max(_rank()).alias("keep"))


def _rank():
    """Orders the rows of a group: the largest is the one that stays."""
    return F.struct("doc_id", (-F.col("row_no")).alias("row"))


def _settled(rows: DataFrame, counters: int) -> DataFrame:
    frequent = materialize(frequent_digests(rows, counters), "dedup-frequent")
    here = rows.join(F.broadcast(frequent), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    rest = rest.withColumn("n", F.count("*").over(group)).withColumn("keep", F.max(_rank()).over(group))
    return here.unionByName(rest).select(
        "doc_id", "row_no", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row_no") == -F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _digests(docs: DataFrame, *others) -> DataFrame:
    """One read of the texts: digest, id and a row number that is fixed once written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), *others)
    return materialize(found.withColumn("row_no", F.monotonically_increasing_id()), "dedup")


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text)."""
    return _settled(_digests(docs), counters).drop("row_no")


def keep_one_of_each(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    whole = _digests(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    kept = _settled(whole.select("doc_id", "digest", "row_no"), counters).filter("kept").select("row_no")
    return whole.join(kept, "row_no", "left_semi").select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
