"""Benchmark decontamination by template windows, in native expressions only.

Texts are brought to templates: numbers, units behind numbers, and names
(capitalised words inside a sentence) become typed placeholders, everything
else lower-case words.  Every WINDOW-token window of every benchmark item is
indexed, filled as in the item and as a template; a document is cut into
consecutive windows (tiles), of both kinds.  A passage of 2 * WINDOW - 1 tokens
or more that a document shares with an item holds a whole tile, so the hash
join of tiles with windows finds it, at a fifth of the rows that all windows of
the documents would be.  Templates of fewer than MIN_PLAIN plain words say too
little at that length: around them, windows of 2 * WINDOW - 1 template tokens
are indexed instead, and those of the documents at every place compared.

Each hit lays the item over the document at one offset.  There the aligned
template tokens are compared, over all offsets that were hit, and the slots:
what fills an item's placeholder must be replaced by the same value wherever
it occurs, so an item with other numbers or names in the same places counts,
and a chance fit of templates does not.  Slots that contradict each other drop
themselves only: of each value the replacement at the most places counts (its
own first), and the others are places not found.  One case goes whole: the
template of the entire item laid over the document with contradicting slots,
which is another question made from the same template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import materialize

WINDOW = 5
#: Least template tokens of an item that is searched by tiles; shorter ones are searched whole and as they stand.
MIN_ITEM_TOKENS = 2 * WINDOW - 1
#: Least share of the item's tokens found in a document, in percent, and plain words a template window of WINDOW tokens must have.
MIN_COVER_PERCENT, MIN_PLAIN = 60, 3
#: A run of so many consecutive places, consistent among themselves, is reported whatever share of the item it is.
MIN_RUN = 13
#: Index rows up to this many are sent to every task, as are candidate ids; beyond, both joins shuffle.
SEND_ROWS = 1_000_000

#: Placeholders, from the private use area.
NUMBER, UNIT, NAME = "\ue001", "\ue002", "\ue003"
UNITS = "km/h mph km cm mm m kg mg g lb oz ms s min h ml l ft in mi kwh kw w v a hz ghz mhz gb mb kb usd eur gbp".split()
_NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
_UNIT = "(?i:" + "|".join(UNITS) + r"|[%$€£°]c?)(?![\p{L}\p{Nd}])"
_NAME = r"\p{Lu}(?<=[^.!?:;\s] .)[\p{L}\p{M}]*"

#: Somewhere among WINDOW tokens, fewer than MIN_PLAIN plain words.
_MARK = f"[{NUMBER}{UNIT}{NAME}]"
_POOR = f"{_MARK} (?:{_MARK} (?:[^ ]+ ){{0,2}}|[^ ]+ {_MARK} (?:[^ ]+ )?|[^ ]+ [^ ]+ {_MARK} ){_MARK}"


def _numbered(text: Column) -> Column:
    there = text.rlike(r"\p{Nd}")
    units = F.regexp_replace(text, f"({_NUMBER}) ?{_UNIT}", f"$1 {UNIT} ")
    return F.when(there, F.regexp_replace(units, _NUMBER, f" {NUMBER} ")).otherwise(text)


def template(text: Column) -> Column:
    """The template tokens of a text, separated by single spaces."""
    named = F.regexp_replace(_numbered(text), _NAME, f" {NAME} ")
    return F.trim(F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NUMBER}{UNIT}{NAME}]+", " "))


def literal(text: Column) -> Column:
    """The tokens of ``template``, filled: numbers and lower-case words as they stand, units behind their mark."""
    units = F.regexp_replace(text, f"({_NUMBER}) ?({_UNIT})", f"$1 {UNIT}$2 ")
    numbers = F.lower(F.regexp_replace(units, f"({_NUMBER})", " $1 "))
    signs = F.regexp_replace(numbers, rf"[.,:/](?<!\p{{Nd}}[.,:/](?=\p{{Nd}}))(?<!{UNIT}km/)|(?<!{UNIT})[%$€£°]", " ")
    kept = rf"\p{{L}}\p{{M}}\p{{Nd}}{NUMBER}{UNIT}{NAME}"
    there = F.regexp_replace(signs, f"[^{kept}.,:/%$€£°]+", " ")
    return F.trim(F.when(text.rlike(r"\p{Nd}"), there).otherwise(F.regexp_replace(F.lower(text), f"[^{kept}]+", " ")))


def _runs(length: int) -> Column:
    """A pattern whose first group is, at each token of a text, the ``length`` tokens from there on."""
    return F.lit(rf"(?<![^ ])(?=((?:[^ ]+ ){{{length - 1}}}[^ ]+)(?![^ ]))")


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): an item's start, in tokens of a document, wherever a tile equals a window."""

    def windows(tokens, length):
        def window(i):
            own = F.slice(tokens, i, length)
            return F.struct((i - 1).alias("from"), F.lit(length).alias("length"), F.array_join(own, " ").alias("window"), F.size(F.filter(own, lambda x: ~x.isin(NUMBER, UNIT, NAME))).alias("plain"))

        return F.transform(F.sequence(F.lit(1), F.size(tokens) - length + 1), window)

    plain = F.filter(windows("tokens", WINDOW), lambda w: w["plain"] >= MIN_PLAIN)
    long = F.filter(windows("tokens", MIN_ITEM_TOKENS), lambda w: w["window"].rlike(_POOR))
    index = items.select("item_id", F.explode(F.concat(plain, windows("words", WINDOW), long)).alias("w"))
    index = index.select("item_id", "w.from", "w.length", F.xxhash64("w.window").alias("h")).distinct()
    index = materialize(index, "leak-index")
    small = index.count() <= SEND_ROWS

    cut = F.lit(f"(?:[^ ]+ ){{{WINDOW - 1}}}[^ ]+")
    texts = docs.select("doc_id", template(F.col("text")).alias("t"), literal(F.col("text")).alias("l"))
    tiles = texts.select("doc_id", F.posexplode(F.arrays_zip(*[F.regexp_extract_all(c, cut, F.lit(0)).alias(c) for c in "tl"])).alias("tile", "words"))
    tiles = tiles.select("doc_id", (F.col("tile") * WINDOW).alias("place"), F.explode(F.array_distinct(F.array("words.t", "words.l"))).alias("words"))
    if not index.filter(F.col("length") > WINDOW).isEmpty():
        longer = docs.select("doc_id", template(F.col("text")).alias("t")).filter(F.col("t").rlike(_POOR))
        longer = longer.select("doc_id", F.posexplode(F.regexp_extract_all("t", _runs(MIN_ITEM_TOKENS), F.lit(1))).alias("place", "words"))
        tiles = tiles.unionByName(longer.filter(F.col("words").rlike(_POOR)))
    tiles = tiles.select("doc_id", "place", F.xxhash64("words").alias("h"))
    hits = tiles.join(F.broadcast(index) if small else index, "h")
    return hits.select("doc_id", "item_id", (F.col("place") - F.col("from")).cast("int").alias("at")).distinct()


def _short(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Short items as they stand anywhere in a document; ``lengths`` are those of the items, in tokens."""
    items = items.select("item_id", F.size("tokens").cast("long").alias("n_item"), F.array_join("words", " ").alias("window"))
    texts = docs.select("doc_id", literal(F.col("text")).alias("l"))
    windows = F.explode(F.concat(*[F.array_distinct(F.regexp_extract_all("l", _runs(n), F.lit(1))) for n in sorted(lengths)]))
    small = items.count() <= SEND_ROWS
    found = texts.select("doc_id", windows.alias("window")).join(F.broadcast(items) if small else items, "window")
    return found.select("doc_id", "item_id", F.col("n_item").alias("n_found"), "n_item", F.lit(True).alias("exact")).distinct()


def _places(n: Column) -> Column:
    """The places k of the item whose token equals the document's as a template or as it stands, laid at ``at``: with both literals, and whether it is a slot."""

    def place(k):
        i = F.greatest(F.col("at") + k, F.lit(0))
        own, theirs = F.get("words", k), F.get("d_words", i)
        same = (F.col("at") + k >= 0) & ((F.get("tokens", k) == F.get("d", i)) | (own == theirs))
        return F.struct(k.alias("k"), own.alias("a"), F.when(same, theirs).alias("b"), F.get("tokens", k).isin(NUMBER, UNIT, NAME).alias("slot"))

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), place), lambda p: p["b"].isNotNull())


def _pairs(places: Column) -> Column:
    """(the item's filling, the document's) of the slots among ``places``."""
    return F.transform(F.filter(places, lambda p: p["slot"]), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))


def _clash(fits: Column) -> Column:
    """Whether distinct pairs give one filling two replacements."""
    return F.size(fits) != F.size(F.array_distinct(F.transform(fits, lambda q: q["a"])))


def _contradicting() -> Column:
    """The pairs of ``fits`` that another replacement of the same filling outdoes in places of ``pairs``."""

    def best(a):
        rivals = F.transform(F.filter("fits", lambda q: q["a"] == a), lambda q: F.struct(F.size(F.filter("pairs", lambda r: r == q)).alias("n"), (q["a"] == q["b"]).alias("own"), q["b"].alias("b")))
        return F.struct(a.alias("a"), F.array_max(rivals)["b"].alias("b"))

    kept = F.transform(F.array_distinct(F.transform("fits", lambda q: q["a"])), best)
    return F.when(F.col("clash"), F.array_except("fits", kept)).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def _has_run() -> Column:
    """Whether somewhere MIN_RUN consecutive places of the item have slots that are consistent among themselves."""

    def whole(i):
        run = F.slice("places", i, MIN_RUN)
        return (F.get(run, F.lit(MIN_RUN - 1))["k"] - F.get(run, F.lit(0))["k"] == MIN_RUN - 1) & (~F.col("clash") | ~_clash(F.array_distinct(_pairs(run))))

    return F.exists(F.sequence(F.lit(1), F.greatest(F.size("places") - MIN_RUN + 1, F.lit(1))), lambda i: F.coalesce(whole(i), F.lit(False)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in ``docs`` (doc_id, text): doc_id, item_id, n_found, n_item, exact.

    ``benchmark`` has item_id and text.  A row for each document and item of
    which the document holds MIN_COVER_PERCENT of the template tokens or more,
    in order, with consistent slots, or MIN_RUN consecutive ones.  A slot that
    contradicts the others is not counted and drops nothing else, so a text with
    one more change never counts more.  ``exact`` says that every place that
    counts is filled as in the item, upper and lower case being one; a copy of the whole template with a
    contradicting slot is not exact, unless another copy in the document is.  Null or empty texts and rows with a null id give
    nothing; repeated rows count once; an item of fewer than MIN_ITEM_TOKENS
    tokens is found where all of it stands, filled as it is.  Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").distinct()
    items = items.select("item_id", F.split(template(F.col("text")), " ").alias("tokens"), F.split(literal(F.col("text")), " ").alias("words"))
    every = materialize(items, "leak-items")
    items = every.filter(F.size("tokens") >= MIN_ITEM_TOKENS)
    short = every.filter((F.size("tokens") < MIN_ITEM_TOKENS) & (F.col("words")[0] != ""))
    hits = materialize(_hits(docs, items), "leak-hits")

    ids = hits.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= SEND_ROWS else ids
    wanted = docs.join(ids, "doc_id", "left_semi")
    wanted = materialize(wanted.select("doc_id", F.split(template(F.col("text")), " ").alias("d"), F.split(literal(F.col("text")), " ").alias("d_words")), "leak-texts")
    laid = hits.join(wanted, "doc_id").join(items, "item_id")

    laid = laid.withColumn("n_item", F.size("tokens")).withColumn("places", _places(F.size("tokens")))
    laid = laid.filter(F.size("places") >= WINDOW)
    laid = laid.withColumn("pairs", _pairs(F.col("places"))).withColumn("fits", F.array_distinct("pairs")).withColumn("clash", _clash(F.col("fits")))
    laid = laid.withColumn("lost", _contradicting()).withColumn("run", _has_run())

    altered = F.col("clash") & (F.size("places") == F.col("n_item"))
    found = laid.select("doc_id", "item_id", "n_item", "run", "lost", altered.alias("altered"), F.explode("places").alias("p"))
    holds = ~(F.col("p.slot") & F.array_contains("lost", F.struct(F.col("p.a").alias("a"), F.col("p.b").alias("b"))))
    found = found.select("doc_id", "item_id", "n_item", "run", "altered", F.col("p.k").alias("k"), F.when(holds, F.col("p.k")).alias("held"), F.when(F.expr("p.a = p.b"), F.col("p.k")).alias("own"))
    # One row per place, then plain counts.
    found = found.groupBy("doc_id", "item_id", "n_item", "k").agg(F.max("held").alias("held"), F.max(F.when(F.col("held").isNotNull(), F.col("own"))).alias("own"), F.max("run").alias("run"), F.max("altered").alias("altered"))
    as_it_stands = (F.count("own") == F.count("held")) & (~F.max("altered") | (F.count("own") == F.col("n_item")))
    found = found.groupBy("doc_id", "item_id", "n_item").agg(F.count("held").alias("n_found"), as_it_stands.alias("exact"), F.max("run").alias("run"))
    found = found.filter(F.col("run") | (F.col("n_found") * 100 >= F.col("n_item") * MIN_COVER_PERCENT))
    found = found.select("doc_id", "item_id", "n_found", F.col("n_item").cast("long"), "exact")
    lengths = [r[0] for r in short.select(F.size("tokens")).distinct().collect()]
    return found.unionByName(_short(docs, short, lengths)) if lengths else found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the documents in which an item was found."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
