"""Document quality from a linear-chain CRF over lines.

Every line is labelled good or bad.  A line is described by its own features
and those of the lines before and behind it; transitions tie neighbouring
labels.  Training gives all lines of a labelled document the document's label
(each class weighs the same).  A document's score is the mean over its lines
of the forward-backward marginal of "good", weighted by line length.

Features are byte counts and word hashes, worked out for many texts at once in
numpy.  Neither labels nor any column but the text enters a score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import row_groups, utf8_column
from footfall.llm.crf import Adam, forward_backward
from footfall.llm.words import word_bounds, word_hashes

#: The training sample: documents of each class, and of a longer one a run of so many lines, which begins anywhere in
#: the text (by a hash of its id).
SAMPLE_DOCS, SAMPLE_LINES = 1000, 400
EPOCHS, BATCH, RATE, DECAY = 40, 100, 0.05, 1e-4
THRESHOLD = 0.3
BATCH_BYTES = 2 << 20
#: Documents are scored in groups of up to so many lines in all, padding included.
GROUP_LINES = 200_000

N_OWN = 13
N_FEATURES = 3 * N_OWN
#: Byte classes that are counted per line.
CLASSES = [b"#*$%&<>", b"|", bytes(range(65, 91)), bytes([*range(97, 123), *range(0xC3, 0xE0)]), b"0123456789", b"!?"]


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and its text's number; an empty text is one empty line."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[lo:hi] == 10) + lo
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    ends_text = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(len(offsets) - 1)])
    order = np.lexsort((starts, text))
    ends = ends[np.lexsort((ends, ends_text))]
    return starts[order], ends, text[order]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x N_FEATURES, line lengths + 1, text number of each line) of the texts between ``offsets``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, ends, text = line_bounds(data, offsets)
    size = (ends - starts).astype(np.float32)
    part = data[lo:hi]
    counts = []
    for chars in CLASSES:
        hit = np.zeros(256, np.int32)
        hit[list(chars)] = 1
        total = np.zeros(len(part) + 1, np.int32)
        np.cumsum(hit[part], out=total[1:])
        counts.append((total[ends - lo] - total[starts - lo]).astype(np.float32))
    symbols, pipes, upper, lower, digits, cries = counts
    # Words by line: a line break is a space, so no word crosses one.
    w_starts, w_ends = word_bounds(data, offsets)
    hashes = word_hashes(data, w_starts, w_ends)
    line = np.searchsorted(starts, w_starts, side="right") - 1
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    n = len(starts)
    words = np.bincount(line, minlength=n).astype(np.float32)
    repeats = np.bincount(line[again], minlength=n).astype(np.float32)
    chars = np.bincount(line, weights=w_ends - w_starts, minlength=n).astype(np.float32)
    # Lines that the text had before.
    whole = word_hashes(data, starts, np.maximum(ends, starts), lower=False) if n else np.zeros(0, np.uint64)
    order = np.lexsort((np.arange(n), whole, text))
    seen = np.zeros(n, np.float32)
    same = (text[order][1:] == text[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    seen[order[1:][same]] = 1
    seen[words == 0] = 0
    last = np.zeros(n, bool)
    there = size > 0
    last[there] = np.isin(data[ends[there] - 1], list(b".!?:"))
    one = np.maximum(size, 1)
    own = np.stack([
        np.log1p(size) / 6, 4 * symbols / one, 4 * pipes / one, upper / np.maximum(upper + lower, 1), digits / one, 4 * cries / one, np.log1p(words) / 5,
        repeats / np.maximum(words, 1), chars / np.maximum(words, 1) / 10, last, seen, words == 0, np.ones(n),
    ], axis=1).astype(np.float32)
    before, behind = np.zeros_like(own), np.zeros_like(own)
    joined = text[1:] == text[:-1]
    before[1:][joined] = own[:-1][joined]
    behind[:-1][joined] = own[1:][joined]
    return np.concatenate([own, before, behind], axis=1), size + 1, text


def padded(features: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, B, F) features and (T, B) live flags of documents given by their first line and line count."""
    t = np.arange(int(count.max()))[:, None]
    live = t < count
    return features[np.where(live, first + t, 0)] * live[:, :, None], live


def new_model() -> dict[str, np.ndarray]:
    return {"w": np.zeros((N_FEATURES, 2)), "trans": np.zeros((2, 2)), "start": np.zeros(2)}


def trained(features: np.ndarray, count: np.ndarray, label: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """A model fitted to documents given by their lines' features in a row, line counts and labels."""
    p = new_model()
    if not len(count):
        return p
    first = np.cumsum(count) - count
    rng, steps = np.random.default_rng(seed), Adam(p, RATE)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    order = np.argsort(count, kind="stable")
    batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
    for epoch in range(EPOCHS):
        steps.rate = RATE / (1 + epoch / 10)
        for i in rng.permutation(len(batches)):
            own = batches[i]
            x, live = padded(features, first[own], count[own])
            share = weight[own] / count[own]
            marginal, pairs, _ = forward_backward(x @ p["w"], p["trans"], p["start"], live, share)
            hot = np.zeros_like(marginal)
            hot[..., 0], hot[..., 1] = label[own] == 0, label[own] == 1
            d = (marginal - hot) * live[:, :, None] * share[None, :, None] / len(own)
            # All transitions of a training document stay in its label.
            stays = np.bincount(label[own], weights=share * (count[own] - 1), minlength=2)
            d_trans = (pairs - np.diag(stays)) / len(own)
            steps.step({"w": np.tensordot(x, d, ([0, 1], [0, 1])) + DECAY * p["w"], "trans": d_trans + DECAY * p["trans"], "start": d[0].sum(axis=0) + DECAY * p["start"]})
    return p


def scores(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text between ``offsets``."""
    features, size, text = line_features(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    good = np.zeros(len(text))
    order = np.argsort(count, kind="stable")
    a = 0
    while a < n:
        # Ascending counts: the last document of a group sets its padding.
        b = a + 1
        while b < n and (b + 1 - a) * count[order[b]] <= GROUP_LINES and count[order[b]] <= 2 * count[order[a]] + 8:
            b += 1
        own = order[a:b]
        x, live = padded(features, first[own], count[own])
        marginal, _, _ = forward_backward(x @ p["w"], p["trans"], p["start"], live)
        at = first[own] + np.arange(len(live))[:, None]
        good[at[live]] = marginal[..., 1][live]
        a = b
    return np.clip(np.bincount(text, weights=good * size, minlength=n) / np.bincount(text, weights=size, minlength=n), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sampled_run(lines: np.ndarray, doc_id: int) -> np.ndarray:
    """All lines, or SAMPLE_LINES in a row from a place that a hash of the id picks among all."""
    start = zlib.crc32(str(doc_id).encode()) % max(len(lines) - SAMPLE_LINES + 1, 1)
    return lines[start : start + SAMPLE_LINES]


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Trains on at most SAMPLE_DOCS documents of each class that are not held out, taken by a hash of the id."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = [own.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for q in (0, 1)]
    # At most 2 * SAMPLE_DOCS rows.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")

    def describe(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(0))
            for a, b in row_groups(np.diff(offsets), BATCH_BYTES):
                features, _, text = line_features(data, offsets[a : b + 1])
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                lines = [sampled_run(features[x:y], i) for x, y, i in zip(cuts, cuts[1:], batch.column(1).slice(a, b - a).to_pylist())]
                flat = pa.array([x.ravel() for x in lines], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), flat], ["doc_id", "quality", "features"])

    found = rows.select("text", "doc_id", "quality").mapInArrow(describe, "doc_id long, quality int, features array<float>").toArrow()
    found = found.sort_by([("doc_id", "ascending")])
    lists = [np.array(x, np.float32).reshape(-1, N_FEATURES) for x in found.column("features").to_pylist()]
    if not lists:
        return new_model()
    count = np.array([len(x) for x in lists])
    return trained(np.concatenate(lists), count, found.column("quality").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) serve training only.  A null text counts as
    empty, and an empty text as one empty line.  A null doc_id gives a null
    held_out; repeated rows are scored each; other columns are ignored.
    Without labelled rows every score is 0.5.
    """
    p = fit(docs, labels) if model is None else model

    def run(batches):
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            found = [scores(p, data, offsets[a : b + 1]) for a, b in row_groups(np.diff(offsets), BATCH_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else [], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
