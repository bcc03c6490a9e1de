"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Every node knows where matching goes on
when no child fits (its failure link) and how many pieces are finished by that
step, so a word's piece count is read off in one pass over its bytes, without
backing up and without building pieces.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import row_groups, utf8_column, worker_cache

BATCH_BYTES = 1 << 20
#: Words whose counts a worker remembers, none longer than CACHE_WORD_BYTES: some 100 MB at most.
CACHE_WORDS, CACHE_WORD_BYTES = 500_000, 64
WORD_START = b" "


def byte_level_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def vocabulary_bytes(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes, by id; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    alphabet = byte_level_alphabet()
    return [bytes(alphabet[c] for c in piece) for piece in sorted(spec["model"]["vocab"], key=spec["model"]["vocab"].get) if piece not in special]


class LongestMatch:
    """The automaton: ``children`` by node, ``fail`` links and finished-piece counts ``done``.

    Every single byte must be a piece, so every word can be matched.
    """

    def __init__(self, pieces: list[bytes]):
        self.children: list[dict[int, int]] = [{}]
        ends = set()
        for piece in pieces:
            node = 0
            for byte in piece:
                to = self.children[node].get(byte)
                if to is None:
                    to = self.children[node][byte] = len(self.children)
                    self.children.append({})
                node = to
            ends.add(node)
        if len(self.children[0]) < 256 or not ends.issuperset(self.children[0].values()):
            raise ValueError("every single byte must be a piece")
        n = len(self.children)
        self.fail, self.done = [0] * n, [0] * n
        level = list(self.children[0].items())
        for _, node in level:
            self.done[node] = 1  # one byte, itself a piece; matching goes on at the root
        queue = [node for _, node in level]
        for node in queue:
            for byte, to in self.children[node].items():
                queue.append(to)
                if to in ends:
                    self.done[to] = 1
                    continue
                # Not a piece: finish what the parent finishes, then go on until this byte fits.
                at, count = self.fail[node], self.done[node]
                while byte not in self.children[at]:
                    count += self.done[at]
                    at = self.fail[at]
                self.fail[to], self.done[to] = self.children[at][byte], count

    def count(self, word: bytes) -> int:
        children, fail, done = self.children, self.fail, self.done
        node = total = 0
        for byte in word:
            to = children[node].get(byte)
            while to is None:
                total += done[node]
                node = fail[node]
                to = children[node].get(byte)
            node = to
        while node:
            total += done[node]
            node = fail[node]
        return total


def _automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    cache = worker_cache()
    if ("match", path) not in cache:
        cache["match", path] = LongestMatch(vocabulary_bytes(path)), {}
    return cache["match", path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_words, n_tokens.

    Words are runs of bytes other than ASCII white space; each is matched
    behind a space, as byte-level vocabularies mark a word's start.  A null or
    blank text has no words and no tokens.  Null ids and repeated rows are
    reported as they are; other columns are ignored.
    """

    def run(batches):
        automaton, known = _automaton(vocabulary)
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            n_words, n_tokens = [], []
            for a, b in row_groups(np.diff(offsets), BATCH_BYTES):
                if len(known) > CACHE_WORDS:
                    known.clear()
                for i in range(a, b):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    try:
                        total = sum(map(known.__getitem__, words))
                    except KeyError:
                        total = 0
                        for w in words:
                            n = known.get(w)
                            if n is None:
                                n = automaton.count(WORD_START + w)
                                if len(w) <= CACHE_WORD_BYTES:
                                    known[w] = n
                            total += n
                    n_words.append(len(words))
                    n_tokens.append(total)
            sizes = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
