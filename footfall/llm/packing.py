"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Pieces (documents, or parts of documents longer than a sequence) and the gaps
of open sequences are brought into one order, by size from large to small.
Read in that order, a gap is an opening bracket and a piece a closing one:
each piece takes the smallest gap not yet taken that it fits into (its
successor).  The sweep is distributed: sizes are whole numbers up to the
sequence length, so the running bracket depth needs only the row counts per
size; a row's own depth follows from its rank among rows of its size, and rows
of equal depth are matched by a window over that depth.  A gap takes one piece
a round (of several candidates the one of the higher rank), then gaps are
updated and the round repeats until nothing fits.

Sequences are opened by a sweep too: at first the largest pieces, as many as
there must be sequences; later, when what is left fits no gap, the remaining
pieces are laid end to end by their running sum and cut at sequence ends; a
piece that straddles an end stays for the next round.

Every round is written to the shared checkpoint folder, so a lost executor
repeats one round.  A round moves ids and sizes only, never tokens.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import materialize, row_groups, utf8_column, worker_cache
from footfall.llm.token_count import vocabulary_bytes

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Bytes of text in a batch of results.
BATCH_BYTES = 1 << 20
#: Rows of one size are ranked in parts of about so many rows.
RANK_ROWS = 16_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document of n tokens: itself, or full pieces behind a first one that may be shorter."""
    full = (n - 1) // capacity
    return [n - full * capacity] + [capacity] * full


#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters behind these may be of another class in one library's Unicode version than in the other's.
BEYOND = re.compile("[^\x00-\u024f]")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the vocabulary file's own tokenizer gives them.

    In such a vocabulary a piece's id is its merge rank, so the faster rank
    encoder gives the same ids from the same file.  It is used for texts in
    Latin letters, where both split alike (a test goes through all of their
    characters); all other texts go to the file's tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = {piece: i for i, piece in enumerate(vocabulary_bytes(path))}
        self.ranked = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if BEYOND.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _encoder(path: str) -> Encoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenizes ``docs`` (doc_id, text; null text: empty), ends each with id 0 and cuts the long ones.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, and with
    ``with_ids`` the ids (array<int>).  An empty text is one piece of one id.
    Rows with equal or null doc_id are separate documents.  Other columns of
    ``docs`` are ignored.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encode = _encoder(vocabulary)
        for batch in batches:
            _, offsets = utf8_column(batch.column(1))
            for a, b in row_groups(np.diff(offsets), BATCH_BYTES):
                doc_ids = batch.column(0).slice(a, b - a).to_pylist()
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                cols = [[], [], [], [], []]
                ids = []
                for doc_id, text in zip(doc_ids, texts):
                    found = encode(text) + end
                    start = 0
                    for k, length in enumerate(piece_lengths(len(found) // 4, capacity)):
                        own = found[4 * start : 4 * (start + length)]
                        for col, x in zip(cols, (doc_id, k, start, length, zlib.crc32(own))):
                            col.append(x)
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                        start += length
                arrays = [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _ranked(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows (kind 0: gap, 1: piece; size; id) with their rank ``r`` in a class and what stands before the class.

    A class is a size, a kind and a part of the rows; there are at most twice
    the capacity times 4 + n_rows / RANK_ROWS classes, so the windows over all
    classes read a bounded table.
    """
    parts = 4 + n_rows // RANK_ROWS
    rows = rows if "kind" in rows.columns else rows.withColumn("kind", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    order = Window.orderBy(F.desc("size"), "kind", "part")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    classes = (
        rows.groupBy("size", "kind", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("level", F.sum(step).over(upto))
        .withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(upto)))
        .select(
            "size", "kind", "part",
            F.coalesce(F.lag("depth").over(order), F.lit(0)).alias("depth"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)).alias("tokens_before"),
        )
    )
    r = F.row_number().over(Window.partitionBy("size", "kind", "part").orderBy("id"))
    return rows.withColumn("r", r.cast("long")).join(classes, ["size", "kind", "part"])


def _seeded(pieces: DataFrame, n_rows: int, k: int, first_seq: int, capacity: int) -> DataFrame:
    """The k largest pieces open a sequence each."""
    rank = F.col("rows_before") + F.col("r")
    seq = F.when(rank <= k, F.lit(first_seq) + rank - 1)
    return _ranked(pieces, n_rows).select(
        "id", "size", seq.alias("seq"), F.when(seq.isNotNull(), F.lit(0)).cast("long").alias("offset"),
        (F.lit(capacity) - F.col("size")).alias("gap"),
    )


def _laid(pieces: DataFrame, n_rows: int, first_seq: int, capacity: int) -> DataFrame:
    """Pieces end to end in new sequences; one that would straddle a sequence's end is left out."""
    start = F.col("tokens_before") + (F.col("r") - 1) * F.col("size")
    laid = _ranked(pieces, n_rows).withColumn("at", start)
    own = F.floor(F.col("at") / capacity).cast("long")
    fits = F.floor((F.col("at") + F.col("size") - 1) / capacity) == own
    # Left out: a group of its own, so that they don't meet in one.
    laid = laid.withColumn("own", F.when(fits, own)).withColumn("grp", F.coalesce(F.col("own"), -1 - F.col("id")))
    w = Window.partitionBy("grp")
    seq = F.lit(first_seq) + F.col("own")
    return laid.select(
        "id", "size", seq.alias("seq"), F.when(seq.isNotNull(), F.col("at") - F.min("at").over(w)).alias("offset"),
        (F.lit(capacity) - F.sum("size").over(w)).alias("gap"),
    )


def _matched(pieces: DataFrame, gaps: DataFrame, n_rows: int) -> DataFrame:
    """One sweep: every piece takes the smallest free gap that holds it, every gap one piece at most."""
    rows = pieces.select(F.lit(1).alias("kind"), "size", "id").unionByName(gaps.select(F.lit(0).alias("kind"), F.col("gap").alias("size"), F.col("seq").alias("id")))
    ranked = _ranked(rows, n_rows)
    level = F.when(F.col("kind") == 0, F.col("depth") + F.col("r")).when(F.col("r") <= F.col("depth"), F.col("depth") - F.col("r") + 1)
    alone = -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    w = Window.partitionBy("level").orderBy(F.desc("size"), "kind", "part", "r")
    taken = (F.col("kind") == 1) & (F.col("level") > 0)
    return ranked.withColumn("level", F.coalesce(level, alone)).select(
        "kind", "id", "size",
        F.when(taken, F.lag("id").over(w)).alias("seq"),
        F.when(taken, F.lag("size").over(w)).alias("seq_gap"),
        F.when(F.col("kind") == 0, F.col("size") - F.coalesce(F.lead("size").over(w), F.lit(0))).alias("left"),
    )


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Places ``pieces`` (id long, unique; size long, 1 to capacity), given as a written table.

    Returns id, seq, offset for every piece: pieces of a sequence fill it
    without gaps from offset 0, and it holds at most ``capacity`` tokens.  No
    rows in, no rows out.
    """
    full = pieces.filter(F.col("size") == capacity).select("id", (-1 - F.col("id")).alias("seq"), F.lit(0).cast("long").alias("offset"))
    placed, left, next_seq, opened = [full], pieces.filter(F.col("size") < capacity).select("id", "size"), 0, 0

    def state(rows):
        return rows.agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.min("size").alias("least"), F.count(F.when(F.col("size") > capacity // 2, 1)).alias("large")).first()

    now = state(left)
    while now.n:
        sequences = -(-now.tokens // capacity)
        if not opened:
            step = _seeded(left, now.n, max(sequences, now.large), next_seq, capacity)
            next_seq += max(sequences, now.large)
        else:
            step = _laid(left, now.n, next_seq, capacity)
            next_seq += sequences
        opened += 1
        step = materialize(step, "pack-open")
        there = step.filter("seq is not null")
        placed.append(there.select("id", "seq", "offset"))
        gaps, left = there.select("seq", "gap").distinct(), step.filter("seq is null").select("id", "size")
        now = state(left)
        while now.n:
            before = now.n
            step = materialize(_matched(left, gaps.filter(F.col("gap") >= now.least), now.n), "pack-round")
            placed.append(step.filter("kind = 1 and seq is not null").select("id", "seq", (F.lit(capacity) - F.col("seq_gap")).alias("offset")))
            gaps = step.filter("kind = 0").select(F.col("id").alias("seq"), F.col("left").alias("gap"))
            left = step.filter("kind = 1 and seq is null").select("id", "size")
            now = state(left)
            if now.n == before:
                break
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset.  See token_pieces for nulls, empty texts and repeats.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity, with_ids).withColumn("id", F.monotonically_increasing_id()), "pack-pieces")
    places = pack(pieces.select("id", F.col("length").alias("size")), capacity)
    return pieces.join(places, "id").drop("id").withColumnsRenamed({"seq": "sequence_id"})
