"""Chat formatting of typed content parts, in native expressions only.

A turn holds a list of typed parts (text, image, audio, document).  The
visitor flattens them in order: neighbouring text parts are joined and escaped
as one text, any other part becomes the placeholder of its type (an unknown
type that of ``other``, so no name out of the data is written between control
marks), and its type, reference and expanded token count go to the
conversation's attachment list in the same order.  Turns are written as

    <|turn|>ROLE<|says|>BODY<|end|>

Control strings inside roles and texts get one backslash behind their first
character (one more, if there are some already), so no text can open or close
a turn, and taking one away gives the text back.  The loss mask is a list of
[start, end) code point ranges of the formatted string: the bodies of the
assistant's turns.

A conversation is one row of the output, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: First character, backslashes, rest: every control string that chat templates commonly use.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"(<|\[)(\\*)\\(\||/?s>|/?INST\]|</?SYS>>)"
TAUGHT_ROLE = "assistant"
#: Tokens that a unit of an attachment expands to: an image's tile, a second of audio, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


#: A part of any type that UNIT_TOKENS does not list.
OTHER = "other"
PLACEHOLDER = r"<\|(" + "|".join([*UNIT_TOKENS, OTHER]) + r")\|>"


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), F.when(kind.isin(*UNIT_TOKENS), kind).otherwise(F.lit(OTHER)), F.lit("|>"))


def part_tokens(part: Column) -> Column:
    """Units (null: 1, negative: 0) times the tokens of a unit (unknown types: 1)."""
    per = F.create_map(*[F.lit(x) for kv in UNIT_TOKENS.items() for x in kv])
    return F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * F.coalesce(per[part["type"]], F.lit(1))


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def written_body(parts: Column) -> Column:
    """Parts as one string.  A run of text parts is escaped as a whole: a control string may lie across its parts."""

    def step(s, p):
        run = F.when(is_text(p), F.concat(s["run"], F.coalesce(p["text"], F.lit("")))).otherwise(F.lit(""))
        done = F.when(is_text(p), s["done"]).otherwise(F.concat(s["done"], escaped(s["run"]), placeholder(p["type"])))
        return F.struct(done.alias("done"), run.alias("run"))

    many = F.aggregate(parts, F.struct(F.lit("").alias("done"), F.lit("").alias("run")), step, lambda s: F.concat(s["done"], escaped(s["run"])))
    return F.when((F.size(parts) == 1) & is_text(parts[0]), escaped(parts[0]["text"])).otherwise(many)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formats ``turns`` (conv_id, turn, role, parts of type PARTS), a row per conversation.

    Returns conv_id, n_turns, formatted, loss_spans (array of start, end) and
    attachments (array of position, type, ref, tokens; positions from 0 in
    order of the placeholders).  Turns go by turn, then role, then body, nulls
    first; a null role, part list or text counts as empty, a null type as
    text, a null part is left out.  Rows with a null conv_id form one
    conversation.  Repeated rows are turns of their own; other columns are
    ignored; an empty table gives no rows.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(PARTS)), lambda p: p.isNotNull())
    body = written_body(parts)
    held = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), body.alias("body"), held.alias("held"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "held"))).alias("turns"))

    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS))
    written = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "")
    # (position, spans) folded over the turns.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(s, t):
        a = s["at"] + F.char_length(head(t))
        b = a + F.char_length(t["body"])
        spans = F.when(t["role"] == TAUGHT_ROLE, F.concat(s["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(s["spans"])
        return F.struct((b + len(END)).alias("at"), spans.alias("spans"))

    flat = F.flatten(F.transform("turns", lambda t: t["held"]))
    attachments = F.transform(flat, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), written.alias("formatted"),
        F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"), attachments.alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts of formatted conversations, and the text under the loss mask, unescaped.

    Adds roles, texts (arrays, by turn), pieces (by turn: the texts around its
    placeholders, and the kinds of these in order) and loss_texts (array, by
    span).  Placeholders stay in ``texts`` as they are; a text that looks like
    one is told apart in ``pieces``.
    """
    pattern = r"(?s)<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>"
    part = lambda i: F.transform(F.regexp_extract_all("formatted", F.lit(pattern), F.lit(i)), unescaped)
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    bodies = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2))
    pieces = F.transform(bodies, lambda b: F.struct(F.transform(F.split(b, PLACEHOLDER, -1), unescaped).alias("texts"), F.regexp_extract_all(b, F.lit(PLACEHOLDER), F.lit(1)).alias("kinds")))
    return formatted.select("*", part(1).alias("roles"), part(2).alias("texts"), pieces.alias("pieces"), masked.alias("loss_texts"))


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def digest_columns(formatted: DataFrame) -> DataFrame:
    """What the output says when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(formatted)
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
