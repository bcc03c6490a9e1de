"""Secret scan with a recursive decoding worklist.

A document is scanned for secrets; then every layer that can be unwrapped from
it (URL escapes, Unicode escapes, base64, and compressed data inside base64)
goes on a worklist, is scanned the same way and unwrapped in turn, until
nothing new appears.  Each layer text is unwrapped once in a document, which
ends cycles.  Data that unpacks to more than 4 MB is read as a stream of pieces that
share 64 KB, so memory does not follow its size; only a nested block that is longer
than that and lies across pieces is read in parts.  Every run of a layer's characters knows the range of the text around
it that it came from, so spans found in a layer are carried outwards through every
place where its text occurs, and reported in document offsets.

Decoded bytes are read as UTF-8 and, where they hold a zero byte, as UTF-16 too;
what is neither is kept byte by byte, so the readable runs between are scanned.  Base64 is decoded line by line and over single line breaks.

Base spans are those found in the document itself; what only a layer shows is
added with ``base`` false.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import SPANS

KINDS = ["assign", "access", "hex"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over single line breaks; the starts of gzip, bzip2 and zlib data in it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
PACKED = re.compile(r"H4sI|Qlpo|e[A-P]")
#: Every secret and everything that can be unwrapped to one has so many of these characters in a row.
ENOUGH = re.compile(r"[\x20-\x7e]{16}")
#: Compressed bytes unpacked at a time, and the most that bzip2 gives at a time; of damaged data, what comes before the damage counts.
STEP, PART = 256, 1 << 18
#: Unpacked bytes that are read as one layer, and what neighbouring pieces of a longer stream share.
WHOLE, OVERLAP = 4 << 20, 64 << 10
#: Compressed data in compressed data, each longer than WHOLE, is followed so deep; what is deeper is scanned as it stands.
STREAMS = 50


def secrets_in(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain secrets of a text; a match that fails its length test is dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


class Layer:
    """A text and the document ranges that its characters came from, a run of characters at a time.

    ``runs``: (start, a, b, own) in order.  With ``own`` the run's characters are
    those from ``a`` on, one by one; otherwise each came from all of [a, b).
    None: the text is its own.  A layer of any length that came from one place
    is one run.
    """

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.size, self.runs = text, len(text), runs
        self.starts = [r[0] for r in runs] if runs is not None else None

    @property
    def from_one(self) -> bool:
        return self.runs is not None and len(self.runs) == 1 and not self.runs[0][3]

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.runs is None:
            return start, end
        k = max(bisect_right(self.starts, start) - 1, 0)
        low, high = [], []
        while k < len(self.runs) and (self.starts[k] < end or not low):
            at, a, b, own = self.runs[k]
            stop = self.starts[k + 1] if k + 1 < len(self.runs) else self.size
            low.append(a + max(start, at) - at if own else a)
            high.append(a + min(end, stop) - at if own else b)
            k += 1
        return min(low), max(high)

    def rewritten(self, parts: list[tuple[int, int, str]]) -> "Layer":
        """This layer, its own or from one place, with the ranges of ``parts`` replaced; replaced characters come from their whole range."""
        text, runs, at, size = [], [], 0, 0
        for start, end, new in parts:
            if at < start:
                runs.append((size, at, start, True))
            if new:
                runs.append((size + start - at, start, end, False))
            text += [self.text[at:start], new]
            size, at = size + start - at + len(new), end
        text.append(self.text[at:])
        if at < len(self.text):
            runs.append((size, at, len(self.text), True))
        if self.from_one:
            return from_one_place("".join(text), self.runs[0][1:3])
        return Layer("".join(text), runs)


def from_one_place(text: str, place: tuple[int, int]) -> Layer:
    return Layer(text, [(0, *place, False)])


def readings(data: bytes) -> list[str]:
    """The bytes as text: UTF-8, and from either byte as UTF-16 of either order where a zero byte shows that it may be."""
    texts = [data.decode("utf-8", "surrogateescape")]
    if b"\0" in data:
        texts += [data[k:].decode(code, "replace") for k in (0, 1) for code in ("utf-16-le", "utf-16-be")]
    return texts


def compressed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:1] == b"\x78"


def inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip, zlib or bzip2 data unpacks to, all members of it, as far as it goes, a bounded part at a time."""
    steps = (c[at : at + STEP] for c in source for at in range(0, len(c), STEP))
    head, first = b"", True
    while True:
        while len(head) < 3 and (more := next(steps, b"")):
            head = (head + more).lstrip(b"" if first else b"\0")
        if not compressed(head) or (head[:1] == b"\x78" and not first):
            return
        unpacker = bz2.BZ2Decompressor() if head[:1] == b"B" else zlib.decompressobj(47)
        try:
            while head and not unpacker.eof:
                if isinstance(unpacker, bz2.BZ2Decompressor):
                    yield unpacker.decompress(head, PART)
                    while not (unpacker.eof or unpacker.needs_input):
                        yield unpacker.decompress(b"", PART)
                else:
                    yield unpacker.decompress(head)
                if not unpacker.eof:
                    head = next(steps, b"")
        except (zlib.error, OSError, ValueError, EOFError):
            return
        if not unpacker.eof:
            return
        head, first = unpacker.unused_data.lstrip(b"\0"), False


def begun(parts: Iterator[bytes], head: bytes = b"") -> bytes:
    """``head`` and so many of the parts that it is longer than WHOLE, or all of them."""
    out, size = [head], len(head)
    while size <= WHOLE and (more := next(parts, None)) is not None:
        out.append(more)
        size += len(more)
    return b"".join(out)


def opened(data: bytes) -> Iterator[bytes]:
    """The data, or what is inside if it is compressed (compressed data in compressed data too).

    What is longer than WHOLE comes in pieces that end at a line's end if one is
    near, each with the last OVERLAP bytes of the piece before.
    """
    head, rest, seen, streams = data, iter(()), set(), 0
    while compressed(head) and any(inflated(iter([head]))):
        seen.add(hashlib.sha256(head).digest())
        parts = inflated(chain([head], rest))
        head = begun(parts)
        if len(head) <= WHOLE:
            rest = iter(())
        else:
            rest, streams = parts, streams + 1
        if streams == STREAMS or hashlib.sha256(head).digest() in seen:
            break
    while len(head) > WHOLE:
        cut = head.rfind(b"\n", WHOLE // 2, WHOLE) + 1 or WHOLE
        yield head[:cut]
        head = begun(rest, head[cut - min(OVERLAP, cut // 2) :])
    yield head


def from_base64(token: str) -> bytes:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def width(c: str) -> int:
    """Bytes that a character of readings()[0] stands for."""
    return 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4


def from_lines(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """What base64 over several lines holds.  It may begin at any of them: one start of each
    alignment reads all that is not compressed, and compressed data shows where it begins."""
    lines = [m.span() for m in LINE.finditer(layer.text, start, end)]
    body = "".join(layer.text[a:b] for a, b in lines)
    places, ends = [layer.place(*line) for line in lines], list(accumulate(b - a for a, b in lines))
    aligned = set()
    for first, at in enumerate([0, *ends[:-2]]):
        if at % 4 in aligned and not PACKED.match(body, at):
            continue
        aligned.add(at % 4)
        raw = from_base64(body[at:])
        for data, (n, text) in ((data, x) for data in opened(raw) for x in enumerate(readings(data))):
            if not ENOUGH.search(text):
                continue
            runs = [(0, min(p[0] for p in places[first:]), max(p[1] for p in places[first:]), False)]
            if data is raw and n == 0:  # each character comes from the lines that its own bytes stand in
                runs, byte, line = [], 0, first
                for k, c in enumerate(text):
                    low = at + byte // 3 * 4 + byte % 3
                    byte += width(c)
                    high = at + (byte - 1) // 3 * 4 + (byte - 1) % 3 + 1
                    while ends[line] <= low:
                        line += 1
                    last = line
                    while ends[last] <= high:
                        last += 1
                    own = min(p[0] for p in places[line : last + 1]), max(p[1] for p in places[line : last + 1])
                    if not runs or runs[-1][1:3] != own:
                        runs.append((k, *own, False))
            yield Layer(text, runs)


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside ``layer``."""
    text = layer.text
    if "%" in text:
        runs = [(*m.span(), readings(binascii.unhexlify(m[0].replace("%", "")))) for m in URL_ESCAPE.finditer(text)]
        if runs:
            yield layer.rewritten([(a, b, new[0]) for a, b, new in runs])
        for a, b, new in runs:
            yield from (from_one_place(x, layer.place(a, b)) for x in new[1:] if ENOUGH.search(x))
    if "\\" in text:
        codes = [(*m.span(), int(m[1] or m[2] or m[3], 16)) for m in UNICODE_ESCAPE.finditer(text)]
        parts = [(a, b, chr(c)) for a, b, c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000]
        if parts:
            yield layer.rewritten(parts)
    for m in BASE64.finditer(text):
        for data in opened(from_base64(m[0])):
            yield from (from_one_place(x, layer.place(*m.span())) for x in readings(data) if ENOUGH.search(x))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            yield from from_lines(layer, *m.span())


def scan(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans of a document with whether they are base spans, by start, then kind.

    Depth first, a text at each depth: what is done is known by its digest only.
    In a layer that came from one place all offsets mean that place, so it is
    told by kinds: its only range is (0, 1).
    """
    base = secrets_in(text)
    spans = {None: set(base)}
    around: dict[tuple | None, list[tuple]] = {None: []}
    seen_top = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    work = [(None, unwrapped(Layer(text)))]
    while work:
        outer, layers = work[-1]
        layer = next(layers, None)
        if layer is None:
            work.pop()
            continue
        digest = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()
        inner = (layer.from_one, digest)
        if not layer.from_one and digest == seen_top:
            inner = None
        elif inner not in spans:
            own = secrets_in(layer.text)
            spans[inner], around[inner] = {(k, 0, 1) for k, *_ in own} if layer.from_one else set(own), []
            work.append((inner, unwrapped(from_one_place(layer.text, (0, 1)) if layer.from_one else Layer(layer.text))))
        layer.text = ""
        around[inner].append((outer, layer))
    new = [(inner, s) for inner, own in spans.items() for s in own]
    while new:
        inner, (kind, a, b) = new.pop()
        for outer, layer in around[inner]:
            span = (kind, *layer.place(a, b))
            if span not in spans[outer]:
                spans[outer].add(span)
                new.append((outer, span))
    own = set(base)
    return sorted(((*s, s in own) for s in spans[None]), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of ``docs`` (doc_id, text): a row per row, with doc_id and spans (kind, start, end, base, value).

    A null text counts as empty; a null doc_id stays null; repeated rows are
    reported each; other columns are ignored.  ``value`` is the document's
    text at the span.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]))

    def run(batches):
        for batch in batches:
            spans = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans.append([{"kind": k, "start": a, "end": b, "base": own, "value": text[a:b]} for k, a, b, own in scan(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)
