"""Personal data by patterns and a character-level BiLSTM with a CRF.

The base finder has an exact pattern per kind.  Its spans on a bounded sample
train a bidirectional LSTM with CRF transitions, in numpy; the model is small
and goes to every task.  A text is read in overlapping windows.  Each window is
decoded by itself; a span belongs to the window whose middle is nearest to it,
one that no window holds whole is put together from the pieces that consecutive
windows cut, and spans that still overlap are settled over the whole text,
longest first.

Cards are told from other long numbers by a checksum, which a character model
does not learn; there the base finder decides and the model adds next to nothing.

Every kind needs a digit or an @ (an anchor), and a span without one is never
accepted; so windows without an anchor are not decoded, but for those over the
characters up to the next white space around an @, which may be pieces of an
address.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import SPANS
from footfall.llm.crf import Adam, best_path, forward_backward

KINDS = ["email", "ip", "card", "phone"]
WIDTH, STRIDE = 64, 32
#: The training sample: different texts (for each kind an equal part of texts that may hold it, one part of others),
#: windows of each of them, and windows in all, again the same for every kind and for none.
SAMPLE_DOCS, TEXT_WINDOWS, SAMPLE_WINDOWS = 1000, 32, 1200
#: What a text that may hold a kind looks like, for the choice of the sample.
HINTS = {"email": r"\S@\S", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][ -]?){13}[0-9]", "phone": r"\+[0-9]"}
EMBED, HIDDEN, BATCH, EPOCHS, RATE = 12, 20, 48, 14, 0.012
#: Windows decoded at once.
DECODE = 512

ANCHOR = re.compile(r"[0-9@]")
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# Possessive repeats: what they take is never given back, which these patterns don't need.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part reaches back from an @ to the last match or other character."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = EMAIL_REST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base finder, by start, then kind as listed."""
    if not ANCHOR.search(text):
        return []
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split(".") if len(x) < 9) and all(len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- characters, windows and labels

#: 0: behind the end; printable ASCII; then other white space, other letters, anything else.
N_CODES = 99


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(points), 98, np.int64)
    plain = (points >= 0x20) & (points < 0x7F)
    out[plain] = points[plain] - 0x1F
    out[(points >= 9) & (points <= 13)] = 96
    out[(points >= 0xC0) & (points < 0x2000)] = 97
    return out


def window_starts(text_codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor."""
    anchors = np.flatnonzero(((text_codes >= 17) & (text_codes <= 26)) | (text_codes == 33))
    k = anchors // STRIDE
    return np.unique(np.concatenate([k, k - (WIDTH // STRIDE - 1)]).clip(0)) * STRIDE


def read_starts(text_codes: np.ndarray) -> np.ndarray:
    """Starts of the windows to decode: those with an anchor, and all over the run without white space around an @."""
    space = np.flatnonzero((text_codes == 1) | (text_codes == 96))
    edges = np.concatenate([[-1], space, [len(text_codes)]])
    right = np.unique(np.searchsorted(edges, np.flatnonzero(text_codes == 33)))
    runs = [np.arange((edges[r - 1] + 1) // STRIDE, (edges[r] - 1) // STRIDE + 1) * STRIDE for r in right]
    return np.unique(np.concatenate([window_starts(text_codes), *runs]))


def windows(text_codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text_codes, np.zeros(WIDTH, np.int64)])
    return padded[starts[:, None] + np.arange(WIDTH)]


def labels_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Per character 0, or 1 + 2 * kind at a span's start, one more inside it."""
    out = np.zeros(n, np.int64)
    for a, b, kind in reversed(spans):
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] = 1 + 2 * KINDS.index(kind)
    return out


# ---- the model

N_LABELS = 1 + 2 * len(KINDS)


def allowed() -> np.ndarray:
    """Penalties of transitions: the inside of a kind only follows that kind."""
    out = np.zeros((N_LABELS, N_LABELS), np.float32)
    for i in range(2, N_LABELS, 2):
        out[:, i] = -1e4
        out[[i - 1, i], i] = 0
    return out


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1
    return {
        "embed": normal(N_CODES, EMBED, scale=0.3), "wx": normal(2, EMBED, 4 * HIDDEN, scale=EMBED**-0.5), "wh": normal(2, HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), "b": bias,
        "wo": normal(2 * HIDDEN, N_LABELS, scale=0.2), "bo": np.zeros(N_LABELS, np.float32), "trans": np.zeros((N_LABELS, N_LABELS), np.float32), "start": np.zeros(N_LABELS, np.float32),
    }


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def emissions(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """Label scores (T, B, K) of code windows x (B, T); with ``keep`` also what the gradient needs."""
    ids = x.T
    t_max, n = ids.shape
    seen = p["embed"][ids]
    both = np.stack([seen, seen[::-1]])  # (2, T, B, E)
    zx = (both.reshape(2, t_max * n, EMBED) @ p["wx"] + p["b"]).reshape(2, t_max, n, 4 * HIDDEN)
    h = c = np.zeros((2, n, HIDDEN), np.float32)
    states, gates = np.empty((2, t_max, n, HIDDEN), np.float32), []
    for t in range(t_max):
        z = zx[:, t] + h @ p["wh"]
        s = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[:, t] = h
        if keep:
            gates.append((i, f, o, g, before, tc))
    hidden = np.concatenate([states[0], states[1, ::-1]], axis=-1)
    emit = hidden @ p["wo"] + p["bo"]
    emit = np.where((ids == 0)[:, :, None] & (np.arange(N_LABELS) > 0), np.float32(-1e4), emit)
    return (emit, (ids, both, states, gates, hidden)) if keep else emit


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of labels y (B, T) and its gradient."""
    emit, (ids, both, states, gates, hidden) = emissions(p, x, keep=True)
    t_max, n = ids.shape
    y = y.T
    trans = p["trans"] + allowed()
    live = np.ones((t_max, n), bool)
    marginal, pairs, log_z = forward_backward(emit, trans, p["start"], live, np.ones(n))
    hot = np.eye(N_LABELS, dtype=np.float32)[y]
    score = (emit * hot).sum() + trans[y[:-1], y[1:]].sum() + p["start"][y[0]].sum()
    own = np.zeros_like(pairs)
    np.add.at(own, (y[:-1].ravel(), y[1:].ravel()), 1)
    d_emit = ((marginal - hot) / n).astype(np.float32)
    d_emit[(ids == 0)] = 0
    out = {"trans": ((pairs - own) / n).astype(np.float32), "start": ((marginal[0] - hot[0]).sum(axis=0) / n).astype(np.float32)}
    out["wo"] = np.tensordot(hidden, d_emit, ([0, 1], [0, 1]))
    out["bo"] = d_emit.sum(axis=(0, 1))
    d_hidden = d_emit @ p["wo"].T
    d_states = np.stack([d_hidden[..., :HIDDEN], d_hidden[::-1, :, HIDDEN:]])
    dz = np.empty((2, t_max, n, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((2, n, HIDDEN), np.float32)
    back = p["wh"].transpose(0, 2, 1)
    for t in range(t_max - 1, -1, -1):
        i, f, o, g, before, tc = gates[t]
        dh = dh + d_states[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[:, t, :, :HIDDEN] = dc * g * i * (1 - i)
        dz[:, t, :, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        dz[:, t, :, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        dz[:, t, :, 3 * HIDDEN :] = dc * i * (1 - g * g)
        dh, dc = dz[:, t] @ back, dc * f
    flat = dz.reshape(2, t_max * n, 4 * HIDDEN)
    previous = np.concatenate([np.zeros((2, 1, n, HIDDEN), np.float32), states[:, :-1]], axis=1).reshape(2, t_max * n, HIDDEN)
    out["wx"] = both.reshape(2, t_max * n, EMBED).transpose(0, 2, 1) @ flat
    out["wh"] = previous.transpose(0, 2, 1) @ flat
    out["b"] = flat.sum(axis=1, keepdims=True)
    d_both = (flat @ p["wx"].transpose(0, 2, 1)).reshape(2, t_max, n, EMBED)
    out["embed"] = np.zeros_like(p["embed"])
    np.add.at(out["embed"], ids, d_both[0] + d_both[1, ::-1])
    return float((log_z.sum() - score) / n), out


def varied(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows with digits and letters redrawn, so that shapes are learned and not strings."""
    out = x.copy()
    for lo, hi in ((17, 27), (34, 60), (66, 92)):  # digits, capitals, small letters
        hit = (out >= lo) & (out < hi) & (rng.random(out.shape) < 0.3)
        out[hit] = rng.integers(lo, hi, int(hit.sum()))
    return out


def trained(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A model fitted to code windows and their labels (N, WIDTH); with none, one that finds nothing."""
    p = new_model(seed)
    if not len(x):
        p["bo"][1:] = -1e3
        return p
    rng, steps = np.random.default_rng(seed), Adam(p, RATE)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            own = order[a : a + BATCH]
            _, grads = gradient(p, varied(x[own], rng), y[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            steps.step({k: g * min(1, 5 / (norm + 1e-9)) for k, g in grads.items()})
    return p


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Labels (N, WIDTH) of code windows, decoded in blocks."""
    trans = p["trans"] + allowed()
    parts = [best_path(emissions(p, x[a : a + DECODE]), trans, p["start"]).T for a in range(0, len(x), DECODE)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.int8)


# ---- spans of a text

def plausible(kind: str, text: str) -> bool:
    """What a span of the model must show to count."""
    n = len(digits_of(text))
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+", text) is not None
    if kind == "ip":
        return text.count(".") == 3 and 4 <= n <= 12 and n + 3 == len(text)
    if kind == "card":
        return 13 <= n <= 19 and n >= len(text) - 6 and luhn(digits_of(text))
    return 9 <= n <= 15 and re.fullmatch(r"[+(0-9][\x20().0-9/-]*[0-9]", text) is not None


def window_spans(starts: np.ndarray, tags: np.ndarray, n: int) -> list[tuple[int, int, str]]:
    """Spans of decoded windows, each from the window whose middle is nearest, or from pieces cut by consecutive windows."""
    out = []
    cut: dict[tuple[int, int], int] = {}  # (start of a window, label): start of the span that goes on behind its end
    rows, cols = np.nonzero((tags > 0) & (tags % 2 == 1))
    for r, a in zip(rows.tolist(), cols.tolist()):
        b, tag = a + 1, int(tags[r, a])
        while b < WIDTH and tags[r, b] == tag + 1:
            b += 1
        start = int(starts[r])
        middle = (a + b) / 2
        first, last = start == 0, start + WIDTH >= n
        if (first or middle >= STRIDE / 2) and (last or middle < WIDTH - STRIDE / 2):
            out.append((start + a, start + b, KINDS[tag // 2]))
        begin = cut.get((start - STRIDE, tag)) if a == 0 else None
        if b == WIDTH and not last:
            cut[start, tag] = start + a if begin is None else begin
        elif begin is not None:
            out.append((begin, start + b, KINDS[tag // 2]))
    return out


def settled(text: str, base: list[tuple[int, int, str]], added: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool]]:
    """Base spans, and added ones that overlap nothing accepted before them, longest first."""
    taken = [(a, b) for a, b, _ in base]
    out = [(*s, True) for s in base]
    for a, b, kind in sorted(set(added), key=lambda s: (s[0] - s[1], s[0], KINDS.index(s[2]))):
        word = text[a:b].strip(" \t\r\n.,;:")
        a += text[a:b].find(word)
        b = a + len(word)
        beside = text[a - 1 : a] + text[b : b + 1]
        if word and ANCHOR.search(word) and plausible(kind, word) and not any(c.isalnum() for c in beside) and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind, False))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(model: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, base) of each text; the windows of all texts are decoded together."""
    base = [base_spans(t) for t in texts]
    own, parts = [], []
    for i, t in enumerate(texts):
        if ANCHOR.search(t):
            c = codes(t)
            starts = read_starts(c)
            own.append((i, starts, len(c)))
            parts.append(windows(c, starts))
    tags = decode(model, np.concatenate(parts)) if parts else None
    added: dict[int, list] = {}
    at = 0
    for i, starts, n in own:
        added[i] = window_spans(starts, tags[at : at + len(starts)], n)
        at += len(starts)
    return [settled(t, b, added.get(i, [])) for i, (t, b) in enumerate(zip(texts, base))]


# ---- on Spark

def sampled_texts(docs: DataFrame, n_docs: int) -> list[int]:
    """Hashes of the sampled texts: for each hint, and for texts without any, the n_docs / 5 smallest.

    A task keeps that many hashes of each and nothing else, so no text is sent anywhere.
    """
    share = max(n_docs // (len(KINDS) + 1), 1)

    def smallest(batches):
        held = [np.zeros(0, np.int64) for _ in range(len(KINDS) + 1)]
        for batch in batches:
            h = batch.column(0).to_numpy()
            flags = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(KINDS))])
            for i, hit in enumerate([*flags.T, ~flags.any(axis=1)]):
                held[i] = np.unique(np.concatenate([held[i], h[hit.astype(bool)]]))[:share]
        for i, own in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own)], ["part", "h"])

    text = F.col("text").cast("string")
    rows = docs.filter(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), *[text.rlike(HINTS[k]).alias(k) for k in KINDS])
    parts = rows.mapInArrow(smallest, "part int, h long").distinct()
    order = Window.partitionBy("part").orderBy("h")
    chosen = parts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= share).select("h").distinct()
    return sorted(r.h for r in chosen.collect())


def training_windows(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_windows: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Code windows and labels from the base spans of a bounded sample of different texts.

    The sample goes by hashes of the texts, so it is the same in every run.
    Of a text TEXT_WINDOWS windows count, those with a span first; equal
    texts count once.
    """

    def cut(batches):
        seen = set()
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                seen.add(h)
                c = codes(text)
                starts = window_starts(c)
                x, y = windows(c, starts), windows(labels_of(len(c), base_spans(text)), starts)
                mixed = np.random.default_rng(h & (2**63 - 1)).permutation(len(starts))
                own = mixed[np.argsort(~(y[mixed] > 0).any(axis=1), kind="stable")][:TEXT_WINDOWS]
                out += [(h, int(k), x[k].astype(np.uint8).tobytes(), y[k].astype(np.int8).tobytes()) for k in own]
            h, k, x, y = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["h", "k", "x", "y"])

    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).filter(F.col("h").isin(sampled_texts(docs, n_docs)) & text.isNotNull())
    # At most n_docs * TEXT_WINDOWS different rows.
    found = rows.mapInArrow(cut, "h long, k long, x binary, y binary").groupBy("h", "k").agg(F.first("x").alias("x"), F.first("y").alias("y")).collect()
    found = sorted((r.h, r.k, bytes(r.x), bytes(r.y)) for r in found)
    x = np.array([np.frombuffer(r[2], np.uint8) for r in found], np.int64).reshape(-1, WIDTH)
    y = np.array([np.frombuffer(r[3], np.int8) for r in found], np.int64).reshape(-1, WIDTH)
    share, taken = n_windows // (len(KINDS) + 1), np.zeros(len(x), bool)
    for kind in [*range(len(KINDS)), None]:
        hit = ((y + 1) // 2 == kind + 1).any(axis=1) if kind is not None else ~(y > 0).any(axis=1)
        taken[np.flatnonzero(hit & ~taken)[:share]] = True
    taken[np.flatnonzero(~taken)[: n_windows - int(taken.sum())]] = True
    return x[taken], y[taken]


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    return trained(*training_windows(docs))


def _batches(model, batch, column: int, rows: int = 500):
    texts = [x or "" for x in batch.column(column).to_pylist()]
    for a in range(0, len(texts), rows):
        yield texts[a : a + rows], find(model, texts[a : a + rows])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base, value) of every row of ``docs`` (doc_id, text).

    Offsets are code points, ends exclusive.  A null text counts as empty;
    null ids and repeated rows are reported as they are; other columns are
    ignored.
    """
    model = fit(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "base": own, "value": t[a:b]} for a, b, k, own in s] for ts, ss in _batches(model, batch, 1) for t, s in zip(ts, ss)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SPANS)


def masked(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the union by the first one's kind."""
    out, at = [], 0
    for a, b, kind, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with personal data in ``text`` replaced and ``n_chars`` (if there) set anew where it was."""
    model = fit(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [masked(t, s) if s else t for ts, ss in _batches(model, batch, at) for t, s in zip(ts, ss)]
            new = [None if o is None else n for o, n in zip(old, new)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([c if n == o else len(n) for c, o, n in zip(cols[k].to_pylist(), old, new)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
