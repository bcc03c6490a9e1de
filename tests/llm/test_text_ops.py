"""Word, token, span and quality operators against plain versions, and their edge cases."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from footfall.llm import pii, quality_crf, quality_rules, secrets, token_count, words
from footfall.llm.common import span_report
from footfall.llm.queries import vocabulary
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, size string, part int, h string"  # names that the operators use inside


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 0, None) for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " \n\t ", "one", "one", "a b c a b c a b c", "Ünï cödé\x0bword ñ 漢字 😀 end.", "x" * 5000, ("lorem ipsum dolor " * 4000).strip()]


def plain_features(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_edges(spark):
    texts = [*EDGES, "same line\nsame line\n\n \nother # | <", "a b a b a", "the end\nthe end"]
    got = {r.doc_id: r for r in quality_rules.quality_features(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_features(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rule_order_never_changes_the_verdict(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = list(quality_rules.rules(F.col("text"), F.col("text")))
    w = rows.withColumn("w", quality_rules.words(F.col("text")))
    both = w.select(*[quality_rules.rejected_by(F.col("text"), F.col("w"), o).isNull().alias(n) for n, o in (("a", names), ("b", names[::-1]))])
    assert both.filter("a <> b").count() == 0
    assert quality_rules.keep_good(rows).columns == rows.columns
    assert quality_rules.keep_good(rows).count() == quality_rules.quality_features(rows).filter("kept").count()


def test_rules_go_by_rejections_per_cost():
    found = {"dear": (10, 0.5), "cheap": (10, 0.01), "cheap2": (9, 0.011), "dear_idle": (0, 0.4), "idle": (0, 0.01), "best": (900, 0.02)}
    assert quality_rules.by_rate(found) == ["best", "cheap", "cheap2", "dear", "idle", "dear_idle"]


def test_a_dear_rule_never_precedes_a_cheap_one_that_rejects_as_much(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").withColumn("w", quality_rules.words(F.col("text")))
    rows = rows.cache()
    dear = quality_rules.n_repeat_words(F.col("w")) >= 0
    for _ in range(2):
        assert quality_rules.by_rate(quality_rules.measured(rows, {"dear": dear, "cheap": F.size("w") >= 0})) == ["cheap", "dear"]
    rows.unpersist()


def test_word_hashes_follow_words():
    data = np.frombuffer("Foo foo  bar\x0bFOO ñ Ñ".encode(), np.uint8)
    s, e = words.word_bounds(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["Foo", "foo", "bar", "FOO", "ñ", "Ñ"]
    h = words.word_hashes(data, s, e)
    assert h[0] == h[1] == h[3] and len(set(h.tolist())) == 4
    # Neighbouring texts without a space between them are apart.
    s, e = words.word_bounds(data, np.array([0, 1, 1, 3, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)][:3] == ["F", "oo", "foo"]


def test_blocks_do_not_change_hashes(monkeypatch):
    data = np.frombuffer(("word another third " * 200).encode(), np.uint8)
    s, e = words.word_bounds(data, np.array([0, len(data)]))
    whole = words.word_hashes(data, s, e)
    monkeypatch.setattr(words, "BLOCK", 50)
    assert (words.word_hashes(data, s, e) == whole).all()


def test_token_counts_equal_greedy_matching(spark):
    pieces = set(token_count.vocabulary_bytes(vocabulary()))
    longest = max(map(len, pieces))

    def greedy(w):
        n = 0
        while w:
            k = next(k for k in range(min(longest, len(w)), 0, -1) if w[:k] in pieces)
            w, n = w[k:], n + 1
        return n

    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [*EDGES, *sample]
    got = {r.doc_id: r for r in token_count.token_counts(docs(spark, *texts), vocabulary()).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        assert (got[i].n_bytes, got[i].n_words) == (len((t or "").encode()), len(w))
        assert got[i].n_tokens == sum(greedy(b" " + x) for x in w)


def test_longest_match_links():
    a = token_count.LongestMatch([bytes([i]) for i in range(256)] + [b"abcd", b"bc", b"bcde", b"cdx"])
    for text, n in ((b"", 0), (b"abc", 2), (b"abcd", 1), (b"abcde", 2), (b"bcdx", 3), (b"abcx", 3)):
        assert a.count(text) == n, text


def plain_base(kind, text):
    found = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }[kind]
    n = lambda s: len(re.sub("[^0-9]", "", s))
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 14 <= n(s) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)),
        "phone": lambda s: 10 <= n(s) <= 15,
    }[kind]
    return [(*m.span(), kind) for m in re.finditer(found, text) if ok(m[0])]


def plain_pii(text):
    return sorted((s for k in pii.KINDS for s in plain_base(k, text)), key=lambda s: (s[0], pii.KINDS.index(s[2])))


PII_EDGES = [
    "a@b.c@d.e f@@g.h x.@y.z. .@a.b a@b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.004 1.2.3.40000000000000", "4111 1111 1111 1111, 4111-1111-1111-1112 4 111",
    "+1 (988) 555-2485 +12345 ++49 30 123456 7 +1-", "0" * 3000, "a" * 3000 + "@", "ñ@é.com ü1.2.3.4", "@" * 300, "+1" * 300,
]


@pytest.mark.parametrize("text", PII_EDGES)
def test_base_spans_edges(text):
    assert pii.base_spans(text) == plain_pii(text)


def test_personal_data_query_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in rows.collect()] + [*EDGES, *PII_EDGES]
    got = {r.doc_id: r for r in span_report(pii.find_personal_data(docs(spark, *texts)), pii.KINDS).collect()}
    for i, t in enumerate(texts):
        base = plain_pii(t or "")
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


def test_model_learns_held_out_windows(spark):
    x, y = pii.training_windows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert len(x) <= pii.SAMPLE_WINDOWS
    cut = len(x) * 3 // 4
    tags = pii.decode(pii.trained(x[:cut], y[:cut]), x[cut:])
    right, kind = tags == y[cut:], (y[cut:] - 1) // 2
    for k in pii.KINDS:
        assert right[(y[cut:] > 0) & (kind == pii.KINDS.index(k))].mean() > 0.9, k
    assert (tags > 0)[y[cut:] == 0].mean() < 0.02


def test_sample_of_different_texts(spark):
    """Many copies of one text, one long text and no text at all: equal texts count once, a text gives a bounded part."""
    many = [(i, "call +44 20 7946 0958 now") for i in range(300)] + [(500, "at 10.0.0.7 and a@b.cd, " * 3000)] + [(600 + i, f"mail u{i}@x.org") for i in range(40)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    x, y = pii.training_windows(docs)
    assert len(x) == 1 + pii.TEXT_WINDOWS + 40 and len(x) == len(y)
    assert len(pii.training_windows(docs.limit(0))[0]) == 0


def test_layer_runs_equal_a_range_per_character():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab%41%42cd") for _ in range(30))
        parts = [(*m.span(), chr(int(m[0][1:3], 16))) for m in re.finditer("%4[12]", text)]
        layer, own, at = secrets.Layer(text).rewritten(parts), [], 0
        for a, b, new in parts:
            own += [(i, i + 1) for i in range(at, a)] + [(a, b)] * len(new)
            at = b
        own += [(i, i + 1) for i in range(at, len(text))]
        for _ in range(20):
            a = rng.randrange(len(layer.text))
            b = rng.randrange(a + 1, len(layer.text) + 1)
            assert layer.place(a, b) == (min(r[0] for r in own[a:b]), max(r[1] for r in own[a:b]))


def test_long_words_are_counted_but_not_remembered(spark):
    from footfall.llm import token_count
    from footfall.llm.queries import vocabulary

    rows = [(i, f"{'x' * 100}{i} short {'é' * 60}") for i in range(50)]
    got = [tuple(r) for r in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()]
    automaton = token_count.LongestMatch(token_count.vocabulary_bytes(vocabulary()))
    assert got == [(i, len(t.encode()), 3, sum(automaton.count(b" " + w) for w in t.encode().split())) for i, t in rows]


def test_sampled_lines_lie_anywhere():
    lines = np.arange(5000)
    starts = [int(quality_crf.sampled_run(lines, i)[0]) for i in range(200)]
    assert min(starts) < 800 and max(starts) > 3800 and len(set(starts)) > 150
    assert len(quality_crf.sampled_run(lines, 3)) == quality_crf.SAMPLE_LINES and len(quality_crf.sampled_run(lines[:7], 3)) == 7


def test_windows_without_an_anchor_cannot_matter():
    c = pii.codes("a" * 200 + "7" + "b" * 200)
    starts = pii.window_starts(c)
    assert all(s <= 200 < s + pii.WIDTH for s in starts) and {s for s in range(0, 400, pii.STRIDE) if s <= 200 < s + pii.WIDTH} == set(starts.tolist())


@pytest.mark.parametrize("before", [0, 3, 20, 31, 40])
def test_spans_longer_than_a_window(monkeypatch, before):
    def decode(model, x):
        inside = (x == 97) | (x == 33)
        return np.where(inside, np.where(np.pad(inside, ((0, 0), (1, 0)))[:, :-1], 2, 1), 0)

    monkeypatch.setattr(pii, "decode", decode)
    for local in (5, 28, 33, 50, 70, 200):
        address = "ñ" * local + "@" + "é" * 5
        text = "x " * (before // 2) + " " * (before % 2) + address + " and so on " * 9
        assert pii.find(None, [text]) == [[(before, before + len(address), "email", False)]], local


def test_masking_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, "to a.b@c.de now", "en", 15), (2, None, None, None), (None, "", "fr", 0), (1, "clean text", "en", 10)], "doc_id long, text string, lang string, n_chars long")
    out = sorted(pii.mask_personal_data(rows).collect(), key=str)
    assert pii.mask_personal_data(rows).schema == rows.schema
    assert sorted(map(str, (r.text for r in out))) == ["", "None", "clean text", "to <EMAIL> now"]
    assert {r.text: r.n_chars for r in out}["to <EMAIL> now"] == 14


SECRET = "password=hunter2hunter2x"


def layered(text):
    import base64
    import gzip
    import urllib.parse

    yield base64.b64encode(text.encode()).decode()
    yield base64.b64encode(gzip.compress(text.encode())).decode()
    yield base64.b64encode(base64.b64encode(gzip.compress(text.encode()))).decode()
    yield urllib.parse.quote(text, safe="")
    yield "".join(f"\\u{ord(c):04x}" for c in text)
    yield urllib.parse.quote(base64.b64encode(text.encode()).decode(), safe="").replace("Q", "%51")


def test_secrets_in_layers():
    for inner in layered(SECRET):
        text = f"héad {inner} tail"
        added = [s for s in secrets.scan(text) if s[0] == "assign" and not s[3]]
        assert added, inner
        for _, a, b, _ in added:
            assert inner.startswith(text[a : a + 4]) or text[a:b] in inner


def test_secrets_of_a_repeated_layer():
    *_, mixed = layers = [x for x in layered(SECRET)]
    for inner in (layers[2], mixed, base64.b64encode(mixed.encode()).decode()):
        text = f"a {inner} b {inner} c {inner}"
        added = {(a, b) for k, a, b, own in secrets.scan(text) if k == "assign" and not own}
        assert all(any(m.start() <= a < b <= m.end() for a, b in added) for m in re.finditer(re.escape(inner), text)), inner


def test_secrets_in_bytes_that_are_not_plain_text():
    noise = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(40)).upper()
    wrapped = [base64.encodebytes(x).decode().rstrip() for x in (gzip.compress(f"{noise} {SECRET} {noise}".encode()), f"{'x ' * 24}{SECRET}".encode())]
    whole = [f"\ufeff{SECRET}\u200b", f"a\xa0b {SECRET}\f", f"\x01\x02{SECRET}\xad"]
    inner = [base64.b64encode(x.encode()).decode() for x in whole] + ["".join(f"%{b:02X}" for b in x.encode()) for x in whole]
    inner += [base64.b64encode(x).decode() for x in (SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), b"\xff\xfe\x80" + SECRET.encode() + b"\xff", b"x" + SECRET.encode("utf-16-le"))]
    inner += [base64.b64encode(gzip.compress(b"first") + gzip.compress(SECRET.encode()) + b"\0\0").decode(), *wrapped, wrapped[0].replace("\n", "\r\n  ")]
    for own in inner:
        for before, after in (("see ", " end"), ("see\nalongwordofmanyletters\n", "\nnext")):
            text = before + own + after
            added = [s for s in secrets.scan(text) if s[0] == "assign" and not s[3]]
            assert any(s[1] < len(before) + len(own) and s[2] > len(before) for s in added), (own, before)
    text = "see " + wrapped[1]
    assert len(wrapped[1].split("\n")) == 2 and ("assign", 4, len(text), False) in secrets.scan(text)


def test_secret_cycles_end():
    import base64

    text = "QUJD" * 10 + " %25%32%35 " + "%2525" * 5
    secrets.scan(text)
    deep = SECRET
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert any(s[0] == "assign" for s in secrets.scan(deep))


@pytest.mark.parametrize("sep", ["\n", " "])
def test_secrets_in_long_streams(monkeypatch, sep):
    import bz2
    import zlib

    monkeypatch.setattr(secrets, "WHOLE", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 300)
    rng = random.Random(3)
    packs = [gzip.compress, bz2.compress, zlib.compress, lambda b: bz2.compress(zlib.compress(gzip.compress(b))), lambda b: gzip.compress(b[:7000]) + gzip.compress(b[7000:])]
    for pack in packs:
        for at in (0, 499, 500, 2000, 4000):
            w = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(4000)]
            raw = sep.join([*w[:at], SECRET, *w[at:]]).encode()
            pieces = list(secrets.opened(pack(raw)))
            assert len(pieces) > 8 and max(map(len, pieces)) <= 5000 and all(p in raw for p in pieces)
            text = f"see {base64.b64encode(pack(raw)).decode()} end"
            assert ("assign", 4, len(text) - 4, False) in secrets.scan(text)


def test_secret_streams_keep_memory_bounded():
    import resource
    import zlib

    packer = zlib.compressobj(9, wbits=31)
    packed = b"".join([packer.compress(bytes(1 << 24)) for _ in range(12)]) + packer.compress(SECRET.encode()) + packer.flush()
    text = f"see {base64.b64encode(packed).decode()}"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert ("assign", 4, len(text), False) in secrets.scan(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # kilobytes; 192 MB unpacked


def test_secret_base_rows(spark):
    pats = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    keep = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [*EDGES, "TOKEN: 'abc' Api_Key=abcdefghijkl", "toKen=123456789012", "AKIA" + "A" * 13]
    got = {r.doc_id: r for r in span_report(secrets.scan_secrets(docs(spark, *texts)), secrets.KINDS).collect()}
    for i, t in enumerate(texts):
        base = [(m.start(), k, m.end()) for k, p in pats.items() for m in re.finditer(p, t or "", re.I | re.A if k == "assign" else 0) if keep[k](m)]
        base.sort(key=lambda s: (s[0], secrets.KINDS.index(s[1])))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in secrets.KINDS] == [sum(s[1] == k for s in base) for k in secrets.KINDS]


def test_quality_scores_held_out(spark):
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_crf.quality_scores(rows, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(out) > 500 and (out.predicted == out.quality).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_quality_scores_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_crf.quality_scores(docs(spark, *EDGES, "a\n\nb\n"), none).collect()
    assert len(got) == len(EDGES) + 1 and all(abs(r.score - 0.5) < 1e-9 for r in got)


def test_line_features_by_text():
    texts = ["", "one\n\ntwo two", "x", "\n"]
    offsets = np.cumsum([0, *map(len, texts)])
    features, size, text = quality_crf.line_features(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    assert text.tolist() == [0, 1, 1, 1, 2, 3, 3] and (size - 1).tolist() == [0, 3, 0, 7, 1, 0, 0]
    assert features[3, 7] == 0.5


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.quality_features(none).count() == 0
    assert token_count.token_counts(none, vocabulary()).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert quality_crf.quality_scores(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
