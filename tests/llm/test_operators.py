"""Each corpus operator against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer

from sparkseam.llm import bpe, decontaminate, embeddings, graph, html, licences, lm, quality, simhash, suffixes, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, row string, key string, node long, t int, w string, hits string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "r", "k", 2, 3, "w", "h") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(n, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "er", "the", "ß", "ou", "st", "é"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    return [" ".join(r.choice(words) + r.choice(["", "", ",", ".\n"]) for _ in range(r.randint(5, 120))) for _ in range(n)]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    t = prose(40)
    shared = prose(1, 9)[0] * 2
    t += [t[3], t[3], t[4] + " tail", shared, "x " + shared + " y", "", "", None, None, "a", "A a  A", "  ", "9 9 9 " * 50, t[5].upper(), "aaaa" * 300, t[6] * 30]
    return t


# 1


def test_decontamination_against_brute_force(spark, texts):
    r = random.Random(5)
    w = [regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in texts]
    items = [" ".join(w[7][2:20]), " ".join(w[8][:13]), " ".join(w[9][:5]), "no such words here at all", "", None, "a", " ".join(r.sample(w[10], min(13, len(w[10])))), " ".join(w[44][:60]), "9 9 9"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(0, items[0], 1)], "item_id long, text string, doc_id long")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(docs(spark, texts), bench).collect()}
    for d, words in enumerate(w):
        hit, found = set(), set()
        for i, t in enumerate(items):
            iw = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
            k = min(13, len(iw))
            for a in range(len(iw) - k + 1 if k else 0):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == iw[a : a + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert got[d] == (len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)), d


def test_decontamination_of_empty_tables_and_repeats(spark):
    d, none = docs(spark, ["one two three"]), docs(spark, [])
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert decontaminate.contamination(none, items).collect() == []
    assert decontaminate.contamination(d, items.limit(0)).first().n_hit == 0
    assert [r.n_hit for r in decontaminate.contamination(d.union(d), items).collect()] == [2, 2]
    assert decontaminate.contamination(docs(spark, ["two three"], [None]), items).first().n_words == 2


def test_proximity(spark):
    d = docs(spark, ["red x x blue", "blue red", "red " + "x " * 20 + "blue", None])
    items = spark.createDataFrame([(1, "red blue"), (2, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.start) for r in decontaminate.proximity_matches(d, items, slack=2).collect()) == [(0, 0), (1, 0)]


# 2


def test_licence_scan(spark):
    mit = dict(reversed(licences.TEXTS))["MIT"]
    t = [mit.upper().replace("SUBLICENSE", "Sub-License"), "(c) 2020 A. B.\n" + mit.replace(",", " ;"), mit + " more", "Copyright 2021 X\n\nreleased under the MIT LICENCE!", "one\nLicensed under CC BY-NC 4.0\ntwo\nLicensed under CC BY-NC 4.0.\nReleased under the MIT Licence", "", None, "nothing"]
    got = {r.doc_id: r for r in licences.scan(docs(spark, t)).collect()}
    assert [got[i].license for i in range(8)] == ["MIT", "MIT", None, "MIT", None, None, None, None]
    assert [(got[i].statements, got[i].n_statements) for i in (3, 4, 5, 7)] == [("MIT", 1), ("CC-BY-NC-4.0,MIT", 3), ("", 0), ("", 0)]
    assert got[5].text_sha256 == got[6].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[i].text_sha256 == hashlib.sha256(licences.canonical(x or "").encode()).hexdigest() for i, x in enumerate(t))
    assert [r.n_statements for r in licences.scan(docs(spark, [t[3], t[3]], [None, 1])).orderBy("doc_id").collect()] == [0, 1]
    assert licences.scan(docs(spark, [])).collect() == []


def test_licence_scan_of_wrapped_and_long_texts(spark):
    wrap = lambda x, w: "\n".join(textwrap.fill(line, w) for line in x.split("\n"))
    t = [(name, "Copyright (c) 2020, A. B.\n\n" + wrap(x, w)) for name, x in licences.TEXTS for w in (40, 57, 64, 70, 76)]
    assert sum("\ncopyright" in x.lower() for _, x in t) > 5
    folder = Path("/usr/share/common-licenses")
    for f, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if (folder / f).exists():
            t.append((name, (folder / f).read_text().upper()))
    got = {r.doc_id: r.license for r in licences.scan(docs(spark, [x for _, x in t])).collect()}
    assert [got[i] for i in range(len(t))] == [name for name, _ in t]
    owners = ["Copyright 2021 X", "© X", "(c) 2020 X", "Copyright: (C) X", "copyright by X", "Copyright [yyyy] [owner]", "(C) Copyright X"]
    wording = ["copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "(c) You must retain", "copyright owner or entity"]
    assert [licences.canonical(x) == "" for x in owners + wording] == [True] * 7 + [False] * 4



# 3


def test_every_pair_within_the_radius_shares_a_key():
    r = random.Random(3)
    for _ in range(2000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        assert any((x & m % 2**64) == (y & m % 2**64) for m in simhash.masks())


def fingerprint(t):
    w = regex.findall(r"[^\x20\x09-\x0D]+", low(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    f = [fingerprint(t) for t in texts]
    comp = list(range(len(f)))
    for _ in f:
        comp = [min(comp[j] for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 3) for i in range(len(f))]
    assert got == {i: (f"{f[i]:016x}", comp[i]) for i in range(len(f))}


def test_simhash_blocks_hold_large_buckets(spark, monkeypatch):
    monkeypatch.setattr("sparkseam.llm.linking.BLOCK", 4)
    t = prose(12, 4)
    t += [x + " more" for x in t] + [" ".join(["w"] * 40 + [str(k)]) for k in range(20)]
    f = [fingerprint(x) for x in t]
    comp = list(range(len(f)))
    for _ in f:
        comp = [min(comp[j] for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 3) for i in range(len(f))]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, t)).collect()} == dict(enumerate(comp))


def test_simhash_of_no_rows_and_null_ids(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    got = simhash.near_duplicates(docs(spark, ["a b c d", "a b c d", "a b c d"], [None, 5, 5])).collect()
    assert [r.component_id for r in got] == [5, 5, 5]


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (50, 50), (41, 40), (60, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {41: 40}


# 4


def test_quality_learns_and_defines_edges(spark):
    good = prose(150, 1)
    bad = [" ".join(x + "!!" for x in t.split()).upper() for t in prose(150, 2)]
    t = [x for pair in zip(good, bad, strict=True) for x in pair] + ["", None]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs(spark, t), labels).collect()
    assert len(rows) == 302
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in rows if r.held_out and r.doc_id < 300]) > 0.95
    assert len(quality.kept(docs(spark, t), labels).columns) == 12
    assert quality.scored(docs(spark, ["x"]), labels.limit(0)).first().score == 0.5
    assert quality.scored(docs(spark, []), labels).collect() == []


# 5


@pytest.mark.parametrize(
    "open_, close",
    [
        ("<article class='post tag-social'><h1>Boats</h1>", "</article>"),
        ("<div id='page' class='layout-with-sidebar'><h1>Boats</h1>", "</div>"),
        ("<form action='/' method=post><h1>Boats</h1>", "</form>"),
        ("<div class='sidebar'><h1>Boats</h1>", "</div>"),
        ("<article><header class='entry-header'><h1>Boats</h1></header>", "</article>"),
    ],
)
def test_html_names_of_wrappers_dont_hide_the_article(open_, close):
    body = " ".join(["the crew went down to the quay and looked at the ropes before they sailed"] * 4)
    page = f"<body><nav><a href=x>Home</a></nav>{open_}<p>{body}</p><p>{body}</p>{close}<div class='sidebar-left'><p>{body[:70]}</p></div><div id='comments'><article><p>Nice.</p></article></div></body>"
    assert html.main_text(page, html.train()) == f"Boats\n\n{body}\n\n{body}"



def test_html_extraction(spark):
    body = "The boats came in late that evening and the harbour was full of people who had waited since noon"
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><div class='has-sidebar'><article><h1>Boats</h1><p>{body} &amp;\n more<br>x</p><p>End.</p></article></div><div class='sidebar'>{body}</div><footer>{body}</footer>"
    p = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.extracted(p).collect()}
    want = f"Boats\n\n{body} & more x\n\nEnd."
    assert got == {1: ("u", want, len(want)), 2: (None, "", 0), 3: ("v", "", 0), 4: ("w", "", 0)}


# 6


def covered(raw, d):
    seen, out = {}, {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - 49):
            seen.setdefault(raw[i][p : p + 50], i)
    for i in raw:
        gone = set()
        for p in range(len(raw[i]) - 49):
            if seen[raw[i][p : p + 50]] < i:
                gone |= set(range(p, p + 50))
        out[i] = gone
    return out


def test_repeats_against_brute_force(spark, texts):
    t = texts + [prose(1, 20 + k)[0] + texts[7][10 * k : 10 * k + 45 + k] + prose(1, 40 + k)[0] for k in range(12)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removed(docs(spark, t)).collect()}
    raw = {i: (x or "").encode() for i, x in enumerate(t)}
    for i, gone in covered(raw, None).items():
        kept = bytes(b for p, b in enumerate(raw[i]) if p not in gone)
        spans = sum(p - 1 not in gone for p in gone)
        assert got[i] == (len(raw[i]), len(gone), spans, hashlib.sha256(kept).hexdigest()), i


def test_merged_transforms_sort_all_suffixes():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(50, 70))) for _ in range(30)]
    strings += [strings[0][:60] + b"b", strings[1]]
    ids = np.arange(len(strings))
    old, suffixes.SHARD = suffixes.SHARD, 300
    try:
        found = suffixes.repeated(strings, ids)
    finally:
        suffixes.SHARD = old
    got = {i: set() for i in ids}
    for s, a, n in found:
        got[s] |= set(range(a, a + n))
    assert got == covered(dict(enumerate(strings)), None)


def test_repeats_of_one_document_long_texts_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 200)
    x = prose(1, 7)[0] * 8
    got = sorted(r.n_removed for r in suffixes.removed(docs(spark, [x, x], [1, 1])).collect())
    assert got == [0, 0]
    assert sorted(r.n_removed for r in suffixes.removed(docs(spark, [x, x, x], [1, 2, None])).collect()) == [0, len(x.encode()), len(x.encode())]
    assert suffixes.removed(docs(spark, [])).collect() == []
    assert suffixes.without_repeats(docs(spark, [x, x])).columns == docs(spark, []).columns


# 7


def test_lm_baseline_and_score(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "TUNING_TEXTS", 5)
    toks = [regex.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = Counter(x for w, k in zip(toks, train, strict=True) if k for x in w)
    n = sum(c.values())
    rows = {r.doc_id: r for r in lm.scored(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, w in enumerate(toks):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + len(c) + 1)) for x in w))
        assert r.score < 0
    assert rows[40].score == pytest.approx(rows[41].score)
    assert lm.scored(docs(spark, [])).collect() == []


def test_lm_probabilities_of_all_bits_sum_to_one():
    s, n = lm.symbols(["the cat", "the dog"])
    code, size = lm.prefix_code(np.bincount(lm.befores(s).astype(np.int64) * lm.SYMBOLS + s, minlength=lm.SYMBOLS**2))
    assert np.exp2(-size.astype(float)).reshape(lm.SYMBOLS, lm.SYMBOLS).sum(1) == pytest.approx(1)
    c = np.zeros((lm.PREDICTORS, 2 << lm.SLOT_BITS), np.uint32)
    lm.tally(c, lm.Bits(s, n, code, size))
    m = lm.Mixer(code, size, [lm.log_odds(x) for x in c])
    one = m.log10(["the cow", "the cat", ""])
    assert one[1] > one[0]
    assert m.log10(["the cat"])[0] == pytest.approx(one[1])


def test_lm_keeps_every_context(spark, monkeypatch):
    """The tables aren't of a fixed size, and few texts are learned from too."""
    t = prose(60, 11)
    want = {r.doc_id: r.score for r in lm.scored(docs(spark, t)).collect()}
    monkeypatch.setattr(lm, "SLOT_BITS", 4)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2_000)
    assert {r.doc_id: r.score for r in lm.scored(docs(spark, t)).collect()} == pytest.approx(want, rel=1e-4)
    learned, size = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(60)], [len(x.encode()) for x in t]
    of = lambda k: sum(want[i] for i in range(60) if learned[i] == k) / sum(size[i] for i in range(60) if learned[i] == k)
    assert of(True) > -0.4 > of(False)


def test_lm_log_odds_are_those_of_all_counts():
    t = prose(12, 12)
    s, n = lm.symbols(t)
    code, size = lm.prefix_code(np.bincount(lm.befores(s).astype(np.int64) * lm.SYMBOLS + s, minlength=lm.SYMBOLS**2))
    key = lm.pair_keys(s, n, np.ones(len(s), np.uint64))[1] >> np.uint64(1)
    chunk = np.repeat(np.arange(12) % 3 - 1, n)
    rows = [(c, 0, *np.unique(key[chunk == c], return_counts=True)) for c in (-1, 0, 1)]
    asked = pa.table([pa.array(x) for x in zip(*[(c, i, lm.packed(k), lm.packed(m.astype(np.uint32))) for c, i, k, m in rows], strict=True)], ["chunk", "id", "keys", "counts"])
    got = lm.answered(asked, code, size).to_pylist()
    count = {False: Counter(), True: Counter()}
    paths = []
    for i, x in enumerate(t):
        raw, path = lm.symbols([x])[0].tolist(), []
        for j, symbol in enumerate(raw):
            context, at = tuple(raw[max(0, j - 5) : j]), (raw[j - 1] if j else lm.END) * lm.SYMBOLS + symbol
            bits = f"{code[at]:b}"[1:]
            path.append((context, symbol, bits))
            for d in range(len(bits)):
                count[False][context, bits[:d], bits[d]] += 1
                count[True][context, bits[:d], bits[d]] += i % 3 != 0
        paths.append(path)
    for c, name in ((-1, "odds"), (0, "odds"), (1, "odds"), (-1, "apart")):
        table = lm.unpacked(next(r for r in got if r["chunk"] == c)[name], np.int8)
        of = [p for i in range(12) if i % 3 - 1 == c for p in paths[i]]
        part = [key[chunk == c]]
        keys = [part[0] << np.uint64(1)] * lm.PREDICTORS
        for (context, _, bits), place in zip(of, lm.places(keys, size)[1], strict=True):
            m = [[count[name == "apart"][context, bits[:d], v] for v in "01"] for d in range(len(bits))]
            assert table[place : place + len(bits)].tolist() == lm.log_odds(np.array(m)).tolist()


# 8


EDGES = [" a b", " \n a", "a\n b", "a \nb", "foo\n \nbar x", "x  y", "a  b c", "tab\tq r", "end ", "\x1c a b", "it's 's don't x", "<|endoftext|> a", "x<|endoftext|>y", "a" * 3000, "!" * 501, "日本語 テキスト", "abab" * 100, "a, b.c d., e"]


def test_bpe_against_tiktoken(spark, texts):
    t = texts + EDGES
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs(spark, t)).collect()}
    for i, x in enumerate(t):
        ids = enc.encode_ordinary(x or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()), x
    assert bpe.round_trip(docs(spark, [])).collect() == []
    assert bpe.token_ids(docs(spark, ["hello"])).first().ids == enc.encode_ordinary("hello")


def test_bpe_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(bpe, "STRINGS_KEPT", 50)
    t = prose(20, 3)
    enc = bpe.Encoder(P.path(bpe.RANKS))
    assert [d.decode() for k in range(0, 40, 3) for d in enc.texts(pa.array((t + t)[k : k + 3]))[1].to_pylist()] == t + t


def test_bpe_white_space_and_long_words_against_tiktoken():
    r, enc = random.Random(2), bpe.Encoder(P.path(bpe.RANKS))
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})
    bits = [" ", "  ", "\n", "a", "b", "é", "漢", "1", "'s", "'", "\t", " \n", "the", "ing", "\u00a0", "\u2003", "😀", ".", ","]
    t = [None, "", " ", "a ", " a"] + ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(1500)]
    t += ["".join(r.choices(a, k=r.randint(200, 1500))) for a in ("ab", "abc", "etaoin", "eta漢é", "qzx", ["the", "ing", "a"], "9") for _ in range(15)]
    t += ["acgt" * 700, "a" * 1000, "abcab" * 300, "漢字" * 400, "".join(r.choices("etaoinshrdlu", k=20_000))]
    ids, back = enc.texts(pa.array(t, pa.string()))
    for x, i, b in zip(t, ids.to_pylist(), back.to_pylist(), strict=True):
        assert i.decode() == " ".join(map(str, ref.encode_ordinary(x or ""))), x
        assert b.decode() == (x or "")


# 9


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((30, 16))
    v = np.concatenate([base, base[:10] + 0.1 * r.standard_normal((10, 16)), base[:1] + 0.02 * r.standard_normal((60, 16)), base[:3] * 2, base[:3]])
    rows = [(i, x.tolist(), 0, 1) for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 0, 1), (n + 1, [0.0] * 16, 0, 1), (n + 2, [float("nan")] + [1.0] * 15, 0, 1), (n + 3, [None] + [1.0] * 15, 0, 1), (n + 4, [float("inf")] * 16, 0, 1), (n + 5, [1.0, 2.0], 0, 1), (n + 6, [], 0, 1)]
    got = {x.vec_id: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node long")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(n, dtype=bool)
    comp = np.arange(n)
    for _ in range(n):
        comp = np.array([min(comp[i], comp[link[i]].min(initial=n)) for i in range(n)])
    wrong = sum(got[i].n_links != link[i].sum() for i in range(n))
    assert sum(got[i].n_links for i in range(n)) >= 0.95 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(n))
    assert wrong <= 4
    assert np.mean([got[i].component_id == comp[i] for i in range(n)]) > 0.95
    for i in range(n, n + 7):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# 10


def test_token_files_against_the_library(spark, texts, monkeypatch):
    t = texts + EDGES
    ids = list(range(len(t)))
    random.Random(1).shuffle(ids)
    lib = Tokenizer.from_file(P.path(tokenfile.TOKENIZER))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.stored(docs(spark, t, ids)).collect()}
    at = 0
    for i, x in sorted(zip(ids, t, strict=True)):
        e = [*lib.encode(x or "", add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes())), x
        at += len(e)
    assert tokenfile.stored(docs(spark, [])).collect() == []


def test_wavelet_matrix():
    a = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint16)
    m = tokenfile.WaveletMatrix(len(a), *tokenfile.WaveletMatrix.parts(a))
    assert (m.all() == a).all()
    for i in (0, 1, 511, 512, 513, 4095, 4096, 4999):
        assert m.access(i) == a[i]
        assert m.rank(int(a[7]), i) == (a[:i] == a[7]).sum()
    where = np.flatnonzero(a == a[7])
    assert [m.select(int(a[7]), k) for k in (0, 1, len(where) - 1, len(where), -1)] == [where[0], where[1], where[-1], -1, -1]
    assert m.select(65535, 0) == -1
    assert len(tokenfile.WaveletMatrix(0, *tokenfile.WaveletMatrix.parts(a[:0])).all()) == 0


def test_occurrences(spark, tmp_path):
    tokenfile.write(docs(spark, ["hello hello", "world", "hello"]), f"{tmp_path}/f")
    token = Tokenizer.from_file(P.path(tokenfile.TOKENIZER)).encode(" hello").ids[0]
    assert [(r.doc_id, r["count"]) for r in tokenfile.occurrences(spark, f"{tmp_path}/f", token).collect()] == [(0, 1)]
