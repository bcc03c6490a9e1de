"""Near-duplicate groups by one-permutation hashing.

1. Each document becomes its set of word shingles and a signature by one
   permutation: the hash range is cut into bins, each bin keeps its least
   hash, and an empty bin copies a full one picked by a chain of hashes of its
   own number (optimal densification).
2. Equal sets are one row from here on (the smallest doc_id stands for them).
3. Bands of the signature are bucket keys.  In each bucket every member is
   linked to the bucket's smallest id only, so a bucket gives as many
   candidate edges as it has members.
4. The candidate edges' components hold every pair that shares a bucket.
   Inside them links are confirmed on full sets: a component is cut into
   blocks of bounded size, pairs of blocks are compared in one task each, and
   only a spanning forest of the confirmed links leaves the task.  No pair of a
   bucket is lost to the star, and no task emits all pairs.
5. The confirmed links' components are the groups.

With 40 bands of 6 rows, two sets of similarity 0.85 miss each other in all
bands with a probability of 6e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize, row_groups, utf8_column
from footfall.llm.components import components
from footfall.llm.words import mix, shingles, word_bounds, word_hashes

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
SHINGLE_WORDS = 5
LINK_PERCENT = 85
BATCH_BYTES = 1 << 20
#: Shingles and sets of a block of a candidate component (a task compares two blocks, its matrices have a cell for each
#: pair of sets); candidates up to SEND_IDS are sent to every task.
BLOCK_SHINGLES, BLOCK_SETS = 65_536, 1_500
SEND_IDS = 1_000_000

FEATURES = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<long>"
_U = np.uint64


def signatures(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """n x BINS signatures of sets given as sorted (owner, hash); owners without hashes get zeros."""
    sig, full = np.zeros((n, BINS), _U), np.zeros((n, BINS), bool)
    if len(value):
        # Bins follow the hash order, so the first of each (owner, bin) run is its least hash.
        bins = (((value >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)
        first = np.ones(len(value), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (bins[1:] != bins[:-1])
        sig[owner[first], bins[first]] = value[first]
        full[owner[first], bins[first]] = True
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        pick = (mix(cols.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt)) % _U(BINS)).astype(np.int64)
        hit = full[rows, pick]
        sig[rows[hit], cols[hit]] = sig[rows[hit], pick[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out ^ parts[:, :, i]) * _U(0x9E3779B97F4A7C15 | 1)
    return out


def _sets(batch, k: int):
    """For row groups of an Arrow batch (..., text): the other columns, and the sets as (row, hash) sorted."""
    data, offsets = utf8_column(batch.column(batch.num_columns - 1))
    for a, b in row_groups(np.diff(offsets), BATCH_BYTES):
        starts, ends = word_bounds(data, offsets[a : b + 1])
        hashes = word_hashes(data, starts, ends)
        text_of = np.searchsorted(offsets[a : b + 1], starts, side="right") - 1
        counts = np.bincount(text_of, minlength=b - a)
        yield [c.slice(a, b - a) for c in batch.columns[:-1]], b - a, *shingles(hashes, text_of, counts, k)


def set_keys(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """2 x n: two hashes of each set."""
    keys = np.zeros((2, n), _U)
    there = np.unique(owner)
    if len(there):
        at = np.searchsorted(owner, there)
        keys[0, there] = np.add.reduceat(mix(value), at)
        keys[1, there] = np.add.reduceat(mix(value ^ _U(0x5851F42D4C957F2D)), at)
    return keys


def _features(batches):
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        for ids, n, owner, value in _sets(batch, SHINGLE_WORDS):
            sizes = np.bincount(owner, minlength=n)
            keys = set_keys(owner, value, n)
            bands = band_keys(signatures(owner, value, n)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], names)


def _set_rows(batches):
    for batch in batches:
        for ids, n, owner, value in _sets(batch, SHINGLE_WORDS):
            cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            keys = set_keys(owner, value, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([*ids, pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.view(np.int64)))], ["id", "k1", "k2", "hashes"])


def spanning_links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (of different sides, or all if there is one side).

    Intersection sizes come from products of 0/1 matrices over the hashes
    that more than one set has, a bounded number of columns at a time.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(n), sizes)
    _, cols, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[shared] = np.arange(len(shared))
    cols = number[cols]
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common = np.zeros((n, n), np.float32)
    wide = max(256, 4_000_000 // n)
    for a in range(0, len(shared), wide):
        lo, hi = np.searchsorted(cols, [a, a + wide])
        m = np.zeros((n, min(wide, len(shared) - a)), np.float32)
        m[rows[lo:hi], cols[lo:hi] - a] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    # Breadth first: every set is expanded once and takes those not seen so far.
    out, seen = [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            front += new.tolist()
            out += [(int(ids[i]), int(j)) for j in ids[new]]
    return out


def _confirm(percent: int):
    def run(key, group):
        ids = group.column("id").to_numpy()
        side = (group.column("block").to_numpy() != key[1].as_py()).astype(np.int8)
        lists = group.column("hashes").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
        links = spanning_links(ids, side, sets, percent) if len(ids) > 1 else []
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_no, component_id, kept of every row; set_no names the group (null: linked with nothing).

    ``docs``: doc_id, text_key, text.  The nodes are sets, numbered as they are
    written, not ids: rows that share an id but not a text are apart.
    """
    features = materialize(docs.mapInArrow(_features, FEATURES), "minhash-features")
    there = features.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal bands, so any of them will do.
    groups = there.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    groups = materialize(groups.withColumn("set_no", F.monotonically_increasing_id()), "minhash-sets")
    members = groups.select("set_no", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("set_no").alias("center"), F.count("*").alias("n")).filter("n > 1")
    stars = members.join(buckets, ["band", "key"]).filter("set_no <> center").select(F.col("set_no").alias("a"), F.col("center").alias("b"))
    candidates = materialize(components(stars), "minhash-candidates").withColumnRenamed("component", "grp")

    # Full sets of the candidates, in blocks of their component; the text of one row of each set will do.
    sized = candidates.join(groups.select(F.col("set_no").alias("id"), F.col("rep").alias("doc_id"), "k1", "k2", F.col("n_shingles").alias("size")), "id")
    shares = sized.groupBy("grp").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    wanted = sized.join(shares, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    wanted = materialize(wanted.select("id", "doc_id", "k1", "k2", "grp", "blocks", "block"), "minhash-blocks")
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= SEND_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    # By id and set: another row of the same id may hold another text; repeated rows hold the set once more.
    sets = texts.mapInArrow(_set_rows, "doc_id long, k1 long, k2 long, hashes array<long>").join(wanted, ["doc_id", "k1", "k2"])
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = sets.withColumn("other", F.explode(others)).select(
        "grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "hashes")
    links = pairs.groupBy("grp", "lo", "hi").applyInArrow(_confirm(percent), "a long, b long")
    found = components(links).withColumnRenamed("id", "set_no")

    named = materialize(groups.select("k1", "k2", "n_shingles", "rep", "set_no").join(found, "set_no", "left").withColumn("set_no", F.coalesce("component", "set_no")), "minhash-named")
    least = named.groupBy("set_no").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "set_no").select("k1", "k2", "n_shingles", "set_no", "component_id")
    linked = there.drop("bands").join(named, ["k1", "k2", "n_shingles"]).select("doc_id", "text_key", "n_shingles", "set_no", "component_id")
    alone = features.filter("n_shingles = 0 or doc_id is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("set_no"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _text_key(text) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def near_duplicate_groups(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * common shingles >= percent * all shingles
    of the two.  A null text or one without words has no shingles and is linked with nothing.
    A row with a null doc_id is linked with nothing, has a null component and
    is kept.  Rows that share a doc_id are documents of their own, linked by
    their texts only.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col("text").cast("string").alias("text"))
    return _grouped(rows, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one_of_each(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """``docs`` (all columns) with exactly one row of each group: that with the smallest doc_id.

    Of several with that id the one with the smallest text hash stays, of equal
    rows any one.  Rows linked with nothing (no words, or a null id) all stay.
    """
    keyed = docs.withColumn("_text_key", _text_key(F.col("text")))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_text_key").alias("text_key"), F.col("text").cast("string").alias("text"))
    found = materialize(_grouped(rows, percent).filter("set_no is not null").select("set_no", "doc_id", "text_key"), "minhash-rows")
    first = found.groupBy("set_no").agg(F.min(F.struct("doc_id", "text_key")).alias("own"))
    staying = first.select("own.doc_id", "own.text_key")
    # By id and text: an id may stay with one text and go with another.
    gone = found.select("doc_id", "text_key").distinct().join(staying, ["doc_id", "text_key"], "left_anti")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    left = keyed.join(gone, (keyed["doc_id"].cast("long") == gone["gone_id"]) & (keyed["_text_key"] == gone["gone_key"]), "left_anti")
    often = found.groupBy("doc_id", "text_key").count().filter("count > 1").join(staying, ["doc_id", "text_key"], "left_semi")
    often = materialize(often.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), "minhash-repeated")
    if not often.isEmpty():
        on = (left["doc_id"].cast("long") == often["gone_id"]) & (left["_text_key"] == often["gone_key"])
        left = left.join(often, on, "left_anti").unionByName(left.join(often, on, "left_semi").dropDuplicates(["doc_id", "_text_key"]))
    return left.select(docs.columns)
