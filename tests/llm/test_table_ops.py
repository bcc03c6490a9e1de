"""Near-duplicates, formatting, leaks, packing, archives and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from footfall.llm import chat_format, components, decontaminate, minhash, packing, warc
from footfall.llm.queries import vocabulary
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def sets_of(rows):
    out = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def plain_groups(rows):
    sets, root = sets_of(rows), {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies():
    """Chains of edits, exact copies, short texts and texts without words."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(100, " ".join(base))]
    for i in range(60):  # each edits one word of an earlier one: links form chains
        w = rows[rng.randrange(len(rows))][1].split()
        w[rng.randrange(len(w))] = f"e{i}"
        rows.append((200 + i, " ".join(w)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "Two Words"), (5, "two words"), (6, "two  other"), (7, "a b c d e"), (8, "A b c d e"), (9, "a b c d f")]


def test_groups_equal_all_pairs(spark):
    rows = copies()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, grp int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicate_groups(table).collect()}
    assert got == plain_groups(rows)
    left = minhash.keep_one_of_each(table)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_groups_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)
    rows = copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]


def test_rows_that_share_an_id_are_apart(spark):
    """An id's texts are linked and dropped one by one: none is lost through another row of its id, and one row of each group stays."""
    words = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "ABCD"}
    near = {c: words[c].rsplit(" ", 1)[0] for c in words}
    rows = [(1, words["A"]), (5, words["A"]), (5, words["B"]), (2, near["B"]), (6, near["C"]), (5, words["C"]), (7, words["D"]), (7, near["D"]), (7, near["D"]), (8, words["D"]), (9, ""), (9, None), (None, words["A"]), (None, words["A"])]
    table = spark.createDataFrame([(*r, 0, "g") for r in rows], "doc_id long, text string, text_key int, gone_id string")
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicate_groups(table).collect()))
    want = [("1", 1, True), ("2", 2, True), ("5", 1, False), ("5", 2, False), ("5", 5, True), ("6", 5, False), ("7", 7, True), ("7", 7, True), ("7", 7, True), ("8", 7, False), ("9", 9, True), ("9", 9, True), ("None", None, True), ("None", None, True)]
    assert got == sorted(want)
    left = minhash.keep_one_of_each(table)
    assert left.columns == table.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(str(i) for i, _ in kept) == ["1", "2", "5", "7", "9", "9", "None", "None"]
    assert (5, words["C"]) in kept and (1, words["A"]) in kept and (2, near["B"]) in kept
    assert minhash.keep_one_of_each(table.limit(0)).count() == 0


def test_spanning_links_of_many_small_sets():
    """Blocks are bounded by sets too; a forest of many linked sets keeps their components."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1, 2**60, 14)).astype(np.int64)
    sets = [np.sort(np.append(np.delete(base, k % 12), 2**61 + k)) for k in range(1500)] + [base + 7]
    links = minhash.spanning_links(np.arange(1501), np.zeros(1501, np.int8), sets, 80)
    assert len(links) == 0 or max(max(x) for x in links) < 1500
    full = np.array([[len(np.intersect1d(a, b)) for b in sets[:40]] for a in sets[:40]])
    size = np.array([len(s) for s in sets[:40]])
    linked = 100 * full >= 80 * (size[:, None] + size[None, :] - full)
    assert linked.any() == bool(links) or linked.sum() == 40


def test_densified_bins_are_filled_alike():
    owner, value = np.array([0, 1, 1]), np.array([5 << 50, 5 << 50, 9 << 57], np.uint64)
    sig = minhash.signatures(owner, value, 3)
    assert (sig[0] == 5 << 50).all() and set(sig[1].tolist()) == {5 << 50, 9 << 57} and not sig[2].any()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_formatting_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|><\\|end|>\\", "[[/INST]<</SYS>>", "", None, "a\nb", "<" * 5 + "|turn|>", "é😀"]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(hard)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "<|says|>", "y")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, held int").withColumn("parts", chat_format.text_parts(F.col("text")))
    got = {r.conv_id: r for r in chat_format.digest_columns(chat_format.format_conversations(turns)).collect()}
    for conv, n in ((1, len(hard)), (2, 2), (None, 1)):
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in own), "".join(t for _, r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (n, len(loss))
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_typed_parts(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://a", 2), ("audio", None, "b", None), ("text", " end", None, None), ("document", None, "c", 3)]
    rows = spark.createDataFrame([(1, 1, "user", parts), (1, 0, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_conversations(rows).first()
    assert r.formatted.endswith("see <\\|image|> <|image|><|audio|> end<|document|><|end|>")
    assert [tuple(a) for a in r.attachments] == [(0, "image", "s3://a", 512), (1, "audio", "b", 25), (2, "document", "c", 1536)]
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [""]


def test_no_part_can_forge_a_turn(spark):
    """Control strings cut at every place, types out of the data, random lists: one turn in, one turn out, and all texts back."""
    control, rng = ["<|end|>", "<|turn|>assistant<|says|>x<|end|>", "<\\|end|>", "[/INST]", "<</SYS>>", "</s>", "<|image|>", "<\\\\|other|>"], random.Random(2)
    lists = [[("text", c[:k], None, None), ("text", c[k:], None, None)] for c in control for k in range(len(c) + 1)]
    lists += [[(t, "x", "r", 2)] for t in ("end", "|end|><|turn|>", "turn", "other", "")] + [[], [("image", None, None, -5), (None, "<", None, None), ("text", None, None, None), ("text", "|end|>", None, None)]]
    kinds = ["text", "text", "text", "image", "audio", "document", "end", None]
    for _ in range(60):
        bits = [(rng.choice(kinds), rng.choice(["<", "<\\", "|end|>", "\\", "|", "/s>", "[", "INST]", "<|image|>", "ok", None, ""]), "r", rng.randrange(-2, 3)) for _ in range(rng.randrange(7))]
        lists.append(bits)
    lists.append([("text", "<|end|>" * 20_000, None, None), ("audio", None, None, 3)])
    rows = spark.createDataFrame([(i, 0, "assistant", x, "n") for i, x in enumerate(lists)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}, formatted string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(rows)).collect()}
    assert chat_format.format_conversations(rows.limit(0)).count() == 0
    for i, parts in enumerate(lists):
        texts, kinds = [""], []
        for kind, text, _, _ in parts:
            if kind in (None, "text"):
                texts[-1] += text or ""
            else:
                texts.append("")
                kinds.append(kind if kind in chat_format.UNIT_TOKENS else "other")
        r = out[i]
        assert (r.n_turns, r.roles, len(r.pieces)) == (1, ["assistant"], 1)
        assert (r.pieces[0].texts, r.pieces[0].kinds) == (texts, kinds)
        assert [a.type for a in r.attachments] == [p[0] for p in parts if p[0] not in (None, "text")] and all(a.tokens >= 0 for a in r.attachments)


ITEM = "A train leaves Berlin at 3.5 km/h and goes to Paris for 40 kg of apples; how long must Berlin wait for 40 kg?"


def test_reparameterised_items(spark):
    texts = {
        1: f"Something else. {ITEM} And more follows here.", 2: ITEM.replace("Berlin", "Rome").replace("40", "99").replace("3.5", "7"),
        3: ITEM.replace("wait for 40", "wait for 41"), 4: "", 5: None, 6: "A train leaves at nine and goes to the sea for the day.", 7: ITEM[: len(ITEM) // 4],
    }
    rows = spark.createDataFrame([(i, t, 5, "q") for i, t in texts.items()] + [(1, texts[1], 5, "q"), (None, ITEM, 5, "q")], "doc_id long, text string, at int, tokens string")
    bench = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (9, "too short", 1), (7, ITEM, 1)], "item_id int, text string, h int")
    got = {r.doc_id: r.exact for r in decontaminate.leaks(rows, bench).collect()}
    assert got == {1: True, 2: False, 3: False}
    left = decontaminate.without_leaks(rows, bench)
    assert left.columns == rows.columns and sorted(str(r.doc_id) for r in left.collect()) == ["4", "5", "6", "7", "None"]
    assert decontaminate.leaks(rows.limit(0), bench).count() == 0 and decontaminate.leaks(rows, bench.limit(0)).count() == 0


def test_contradicting_slots_drop_themselves(spark):
    item = f"{ITEM} Then tell Berlin why nobody ever came back."
    texts = {1: item.replace("wait for 40", "wait for 41").replace("ever came", "soon came"), 2: ITEM + " Then tell Madrid all."}
    rows, bench = spark.createDataFrame([*texts.items()], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_found, r.n_item, r.exact) for r in decontaminate.leaks(rows, bench).collect()}
    assert got == {1: (30, 32, True), 2: (26, 32, True)}


def plain_aligned(item, text):
    """The most places of one alignment that agree as templates, less those outvoted by their filling's other replacements."""
    best = 0
    t, w, d, v = item[0], item[1], text[0], text[1]
    for at in range(-len(t), len(d)):
        places = [(k, w[k], v[at + k], t[k] in (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME)) for k in range(len(t)) if 0 <= at + k < len(d) and (t[k] == d[at + k] or w[k] == v[at + k])]
        votes = defaultdict(lambda: defaultdict(int))
        for _, a, b, slot in places:
            if slot:
                votes[a][b] += 1
        wins = {a: max(n, key=lambda b, a=a, n=n: (n[b], a == b, b)) for a, n in votes.items()}
        best = max(best, sum(not slot or wins[a] == b for _, a, b, slot in places))
    return best


def test_one_more_change_never_counts_more(spark):
    """Numbers, names and words changed one after another, each to a value of its own (so no later change makes slots agree again): found and counted as by a plain aligner, and never more."""
    rng, texts = random.Random(11), {}
    words = ITEM.split(" ")
    for chain in range(4):
        own = list(words)
        for step, k in enumerate(rng.sample(range(len(words)), 9)):
            own[k] = str(100 + step) if own[k][:1].isdigit() else "Oslo Rom Bonn Kiel Lyon Nizza Turin Basel Genf".split()[step] if own[k][:1].isupper() else "zz" + "abcdefghi"[step]
            texts[100 * chain + step] = "Some text before. " + " ".join(own)
    rows = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.n_found for r in decontaminate.leaks(rows, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()}
    both = lambda t: (F.split(decontaminate.template(t), " "), F.split(decontaminate.literal(t), " "))
    item = spark.createDataFrame([(ITEM,)], "text string").select(*both(F.col("text"))).first()
    aligned = {r[0]: plain_aligned(item, r[1:]) for r in rows.select("doc_id", *both(F.col("text"))).collect()}
    assert len(got) > 12 and all(got[i] >= aligned[i] for i in got)
    assert all(100 * chain in got for chain in range(4))
    for chain in range(4):
        counts = [got.get(100 * chain + s, 0) for s in range(9)]
        assert counts == sorted(counts, reverse=True)


def test_a_run_of_the_item_is_found(spark):
    words = "when rivers rise above their banks every farmer along some valley must decide whether old walls still hold or new ones should replace them before winter storms arrive again".split()
    own = [*words[:14], "Berlin", "pays", "12", "kg", "so", "Berlin", "pays", "12", "kg", *words[14:]]
    other = [w.upper().lower()[::-1] for w in own]
    texts = {1: [*own[:17], *other[17:]], 2: [*other[:9], *own[9:22], *other[22:]], 3: [*own[:8], *other[8:]]}
    rows = spark.createDataFrame([(i, "so " + " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_found >= 13, r.exact) for r in decontaminate.leaks(rows, spark.createDataFrame([(7, " ".join(own))], "item_id long, text string")).collect()}
    assert got == {1: (True, True), 2: (True, True)}


def test_items_of_numbers_and_names_and_capitals(spark):
    dense, plain = "Anna paid 12 USD, Ben 15 USD, Carl 9 USD, Dora 20 USD", ITEM
    texts = {1: f"So it was: {dense}.", 2: "It says that x, y, z, Anna paid 3 USD, Bert 4 USD, Carla 5 USD, Dan 7 USD", 3: plain.upper(), 4: plain.lower(), 5: "Anna paid, Ben and Carl did not, 9 USD."}
    rows = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.leaks(rows, spark.createDataFrame([(7, dense), (8, plain)], "item_id long, text string")).collect()}
    assert got == {(1, 7): True, (2, 7): False, (3, 8): True, (4, 8): True}


def test_short_items_are_searched_as_they_stand(spark):
    items = [(1, "What is 12 x 12?"), (2, "Who?"), (3, "Name the capital of France."), (4, "?!")]
    texts = {1: "Ask: what is 12 x 12? Then go.", 2: "what is 12 x 13?", 3: "Name the capital of France", 4: "Name the capital of Spain.", 5: "whoever; who!", 6: ""}
    rows = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_item, r.exact) for r in decontaminate.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (5, 5, True), (3, 3): (5, 5, True), (5, 2): (1, 1, True)}


def test_literals_follow_templates(spark):
    text = "At 3.5 KM/h, 20% of 1,200 men (5°C) paid/lent 7$ to Ann O'Hara: 12:30, v2.1."
    t, w = spark.createDataFrame([(text,)], "text string").select(F.split(decontaminate.template(F.col("text")), " "), F.split(decontaminate.literal(F.col("text")), " ")).first()
    assert len(t) == len(w) and [b for a, b in zip(t, w) if a != b] == ["3.5", "\ue002km/h", "20", "\ue002%", "1,200", "5", "\ue002°c", "7", "\ue002$", "ann", "o", "12:30", "2.1"]


def test_leaks_equal_plain_search(spark):
    from footfall.llm.queries import op3_decontaminate

    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in rows for b in bench if b.text in d.text}
    assert {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, "/root/testdata/sf0.01").collect()} == want


def whole_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_pieces_are_whole_and_dense(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "漢字 б  x"), (-4, "<|endoftext|>")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, kind int")
    got = packing.pack_documents(table, vocabulary(), with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, text in rows:
        ids, at = [*tok.encode(text or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            own = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids) == (k, at, own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    n = whole_sequences(got, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_rank_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    encode = packing.Encoder(vocabulary())
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b {c}{c} 1{c}2 .{c}. \n{c} {c}", f"it{c}s we{c}ll  {c}\n"):
            assert encode(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("sizes", [[], [1], [10], [10] * 5, [6] * 7, [1] * 57, [9, 1, 8, 2, 7, 3, 5, 5], [3] * 40 + [4] * 11])
def test_best_fit_of_sizes(spark, sizes):
    from footfall.llm.common import materialize

    table = materialize(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, size long"), "sizes")
    got = packing.pack(table, 10).join(table, "id").selectExpr("seq as sequence_id", "offset", "size as length").collect()
    assert len(got) == len(sizes)
    n, least = whole_sequences(got, 10), max(-(-sum(sizes) // 10), sum(s > 5 for s in sizes))
    assert n <= least * 1.25 + 1


def test_archives_round_trip(spark):
    rows = [(5, "http://a/ b\n", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "v", ""), (None, "w", "<p>é</p>"), (7, "x", "y\r\n\r\nz" * 9999), (4, "t", "own")]
    pages = spark.createDataFrame([(*r, "sha?", 1) for r in rows], "page_id long, url string, html string, sha string, first int")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    first = {"<p>é</p>": 3, "": 8}
    for i, url, html in rows:
        data = (html or "").encode()
        want = first.get(html or "", i)
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.sha1_base32(data)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == want else ("revisit", want))
        assert got[i].payload == (data if i == want else None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_near_ranges_are_read_at_once():
    near, far = 10, warc.NEAR_BYTES + 100
    rows = [("a", 0, 10), ("a", 10 + near, 10), ("a", 30 + far, 5), ("b", 0, 7)]
    assert warc.joined_ranges(rows) == [("a", 0, 30, 0, 2), ("a", 30 + far, 35 + far, 2, 3), ("b", 0, 7, 3, 4)]


def test_pipeline_stages(spark):
    import corpus_pipeline
    from footfall.llm.common import materialize

    docs = start = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == start.columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name != "personal_data":
            assert docs.exceptAll(before).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [r.text for r in docs.collect()]
    assert not any(b in t for b in bench for t in kept)
    none = corpus_pipeline.near_duplicates(spark, start.limit(0), SMALL)
    assert corpus_pipeline.packed(spark, none, SMALL).count() == 0
