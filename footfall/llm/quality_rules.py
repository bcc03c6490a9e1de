"""Quality rules as a short-circuit cascade, in native expressions only.

Each rule is an expression that says whether a text is rejected.  On a bounded
sample the cascade measures what every rule costs (time) and rejects, puts the
rules in order of rejections per cost, and nests them in one CASE expression:
Spark evaluates a branch only for rows that no earlier one has decided.  The
order changes the work, never the verdict, since a text is kept only if no
rule rejects it.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import SPACE_CHARS, SPACE_CLASS, let, materialize

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that the rules' cost and selectivity are measured on.
SAMPLE_ROWS = 1000
#: Timed passes over the sample for each rule; a rule is never taken to cost less than LEAST_SECONDS there.
REPEATS, LEAST_SECONDS = 3, 0.004

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rejected beyond these: symbols per 100 words, duplicate lines and capital letters in percent,
#: mean word length (code points), words with a letter in percent.
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT, MAX_CAPITALS_PERCENT = 30, 40, 50
WORD_LENGTH = (2, 15)
MIN_LETTER_WORDS_PERCENT = 60


def words(text: Column) -> Column:
    """The words of a text, in order; none if it is null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def covered(hashes):
        placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), F.size(hashes)).alias("at")))

        def again(s):
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, again))

    n = F.size(w)
    windows = F.arrays_zip(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), F.slice(w, 3, n - 2))
    found = let(F.transform(windows, lambda z: F.xxhash64(z["0"], z["1"], z["2"])), covered)
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


def _percent(part: Column, whole: Column, limit: int) -> Column:
    return part * 100 > whole * limit


def rules(text: Column, w: Column) -> dict[str, Column]:
    """Name -> whether the rule rejects.  ``w`` is a column that holds the words."""
    n, bare = F.size(w).cast("long"), F.coalesce(text, F.lit(""))
    lines = lines_with_words(text)
    capitals = F.char_length(F.regexp_replace(bare, r"[^\p{Lu}]+", ""))
    letters = F.char_length(F.regexp_replace(bare, r"[^\p{L}]+", ""))
    spoken = F.size(F.filter(w, lambda x: x.rlike(r"\p{L}")))
    return {
        "few_words": n < MIN_WORDS,
        "symbols": _percent(n_symbols(text), n, MAX_SYMBOLS_PERCENT),
        "word_length": (word_chars(w) < n * WORD_LENGTH[0]) | (word_chars(w) > n * WORD_LENGTH[1]),
        "duplicate_lines": _percent(n_dup_lines(lines), F.size(lines), MAX_DUP_LINES_PERCENT),
        "capitals": _percent(capitals, letters, MAX_CAPITALS_PERCENT),
        "few_letters": spoken * 100 < n * MIN_LETTER_WORDS_PERCENT,
        "repeated_words": _percent(n_repeat_words(w), n, MAX_REPEAT_PERCENT),
    }


def measured(sample: DataFrame, found: dict[str, Column]) -> dict[str, tuple[int, float]]:
    """Rule name -> (rows rejected, seconds) on ``sample`` (text, w).

    The time of a pass that asks no rule (reading, splitting, starting the job) is taken off.  A first
    round warms up and is not counted; of the others the shortest time counts, since what disturbs a pass only adds to it.
    """
    passes = {None: F.size("w") < 0, **found}
    best: dict[str | None, float] = {}
    hits = {}
    for turn in range(1 + REPEATS):
        for name, rejects in passes.items():
            began = time.perf_counter()
            # The words are read in every pass, so that the empty one pays for them too.
            hits[name] = sample.agg(F.count_if(rejects).alias("n"), F.sum(F.size("w"))).first().n
            spent = time.perf_counter() - began
            if turn:
                best[name] = min(spent, best.get(name, spent))
    return {name: (hits[name], max(best[name] - best[None], LEAST_SECONDS)) for name in found}


def measured_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, by rejections per second on a sample of ``docs`` (text), best first.

    About ``sample_rows`` rows from all over the table, each row with the same chance.  Rules whose
    rates agree to a factor of two, which is what timing can tell, stay in the order of
    :func:`rules` (cheap ones first); one that rejects nothing there comes after those that do.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = materialize(docs.select(F.col("text").cast("string")).sample(share, seed=5).withColumn("w", words(F.col("text"))), "rules-sample")
    found = measured(sample, rules(F.col("text"), F.col("w")))
    return by_rate(found)


def by_rate(found: dict[str, tuple[int, float]]) -> list[str]:
    """Names by rejections per second in steps of two, falling; without rejections by cost in such steps, rising; else as given."""

    def rank(name):
        n, cost = found[name]
        return (0, -round(math.log2(n / cost))) if n else (1, round(math.log2(cost)))

    return sorted(found, key=rank)


def rejected_by(text: Column, w: Column, order: list[str]) -> Column:
    """The first rule, in this order, that rejects; null if none does."""
    own = rules(text, w)
    verdict = F.when(own[order[0]], F.lit(order[0]))
    for name in order[1:]:
        verdict = verdict.when(own[name], F.lit(name))
    return verdict


def quality_features(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words.  Repeated rows and null ids are reported as they are; other columns are ignored.
    """
    order = measured_order(docs)
    text, w = F.col("text"), F.col("w")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("w", words(text))
    rows = rows.select(
        "doc_id", "text", "w", F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(lines_with_words(text)).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | _percent(F.col("n_repeat_words"), F.col("n_words"), MAX_REPEAT_PERCENT)
    # What the base columns have decided need not be worked out again.
    rest = [x for x in order if x not in ("few_words", "repeated_words")]
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected_by(text, w, rest).isNull())
    return rows.withColumn("kept", kept).drop("text", "w")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the rows that a rule rejects."""
    order = measured_order(docs)
    # Bound once: a filter on a column of words would be rewritten to split the text in every rule.
    verdict = let(words(F.col("text")), lambda w: rejected_by(F.col("text"), w, order))
    return docs.filter(verdict.isNull())
