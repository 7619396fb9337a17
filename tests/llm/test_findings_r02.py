"""Small cases of round 2's findings on the corpus operators."""

from __future__ import annotations

import random
import weakref
from collections import Counter

import numpy as np

import corpus_pipeline
from sparkseam.llm import bpe, common, lm, suffixes


def test_the_encoder_goes_when_another_operator_gives_memory_back():
    path = bpe.public_tokenizers.path(bpe.RANKS)
    first = bpe.encoder(path)
    common.give_back(bpe.encoder)
    assert bpe.encoder(path) is first
    common.give_back()
    assert bpe.encoder(path) is not first
    common.give_back()


def test_a_merge_sorts_once_for_two_characters(monkeypatch):
    r = random.Random(5)
    # A stretch that many strings share after beginnings of their own takes all rounds.
    shared = bytes(r.choice(b"abcd") for _ in range(80))
    shards, heads, whole = [], [], []
    for k in range(3):
        strings = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 9))) + shared[: 60 + r.randint(0, 20)] for _ in range(20)]
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        _, before, head = suffixes.transform(text, np.flatnonzero(text == suffixes.END))
        shards.append(before)
        heads.append(head)
        whole += [(s[i:] + b"\xff", k) for s in strings for i in range(len(s) + 1)]
    sorts, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or sort(*a, **b))
    z = suffixes.merged(shards, heads=heads)
    assert len(sorts) <= 2 + suffixes.LENGTH - suffixes.HEAD
    monkeypatch.undo()
    # Suffixes that agree in LENGTH characters may stand in any order: the shards' rows in each such group are the same.
    group = [s[: suffixes.LENGTH] for s, _ in sorted(whole)]
    want = sorted((s[: suffixes.LENGTH], k) for s, k in whole)
    assert sorted(zip(group, z.tolist(), strict=True)) == want


def test_a_chunks_tokens_are_looked_up_by_number():
    texts, learn = ["b a\x1cB c", None, "a  d é", "", "d D"], [True, False, False, True, True]
    every = [lm.tokens(t) for t in texts]
    w = lm.Words(texts, 3)
    assert [w.words[k] for k in w.place] == [x for t in every for x in t]
    assert w.n.tolist() == list(map(len, every))
    assert sorted(set(w.words)) == sorted(w.words)
    assert [w.words[a:e] for a, e in zip(w.cuts, w.cuts[1:])] == [sorted(x for x in w.words if lm.xxhash.xxh64_intdigest(x) % 3 == b) for b in range(3)]
    taught = Counter(x for t, yes in zip(every, learn, strict=True) if yes for x in t)
    assert dict(zip(w.words, w.counts(learn).tolist(), strict=True)) == {x: taught[x] for x in w.words}


def test_kept_strings_are_made_once_and_the_oldest_forgotten():
    made = []
    kept = bpe.Kept(lambda a: made.extend(a.to_pylist()) or [bpe.pc.utf8_upper(a)], 4)
    for given, new in ((["a", "b", "c"], "abc"), (["b", "d"], "d"), (["e", "d"], "e"), (["d", "e", "b"], "b"), ([], "")):
        made.clear()
        assert kept.of(lm.pa.array(given, lm.pa.string()))[0].to_pylist() == [x.upper() for x in given]
        assert made == list(new)


def test_parts_of_letters_are_told_by_columns():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    letters, space = bpe.regex.compile(r"\p{L}").fullmatch, bpe.regex.compile(r"\s").fullmatch
    stem, closer, alone = (x.to_pylist() for x in bpe.stems(lm.pa.array(every, lm.pa.string())))
    assert stem == every and set(closer) == {""}
    assert all(letters(c) for c, yes in zip(every, alone, strict=True) if yes)
    assert all(yes for c, yes in zip(every, bpe.odd(lm.pa.array(every, lm.pa.string())).to_pylist(), strict=True) if space(c))
    parts = ["", ".", "é.", "ab,", "a.b", "a..", "a1.", "日本", "x;"]
    stem, closer, alone = (x.to_pylist() for x in bpe.stems(lm.pa.array(parts)))
    assert stem == ["", ".", "é", "ab", "a.b", "a..", "a1.", "日本", "x;"]
    assert closer == ["", "", ".", ",", "", "", "", "", ""]
    assert [bool(x) for x in alone] == [False, False, True, True, False, False, False, True, False]


def test_a_batch_asks_for_its_words_once(monkeypatch):
    enc, asked = bpe.Encoder(bpe.public_tokenizers.path(bpe.RANKS)), []
    run = enc.run
    monkeypatch.setattr(enc, "run", lambda words: asked.append(words.to_pylist()) or run(words))
    ids, back = enc.texts(lm.pa.array(["Ab cd, cd 1x,", "", "é. cd", None, " a", "x" * 300]))
    assert back.to_pylist() == [b"Ab cd, cd 1x,", b"", "é. cd".encode(), b"", b" a", b"x" * 300]
    # Once for all parts; blocks of long words and texts as a whole come after.
    assert set(asked[0]) >= {b"Ab", b" cd", b",", b" 1", b"x", "é".encode(), b"."}
    asked.clear()
    assert enc.texts(lm.pa.array(["cd Ab cd,"]))[1].to_pylist() == [b"cd Ab cd,"]
    # A text's first part has been met with a space too.
    assert asked == [[b"cd"]]


def test_distinct_windows_and_words_give_every_symbols_pair():
    r = random.Random(7)
    texts = [None, "", "a", "ab cd ab", " é\tb", "x\n\n", "Ab " * 9] + ["".join(r.choices("ab é\n", k=r.randint(0, 40))) for _ in range(40)]
    learns = np.array([r.random() < 0.6 for _ in texts])
    s, n = lm.symbols(texts)
    code, size = lm.prefix_code(np.bincount(lm.befores(s).astype(np.int64) * lm.SYMBOLS + s, minlength=lm.SYMBOLS**2))
    spelled, taught = lm.Spelled(s, n), np.repeat(learns, n)
    keys = lm.pair_keys(s, n, taught.astype(np.uint64))
    for key, (u, c) in zip(keys, lm.counted_pairs(s, n, spelled, learns), strict=True):
        assert u.tolist() == np.unique(key >> np.uint64(1)).tolist()
        assert dict(zip(u.tolist(), c.tolist())) == {k: Counter((key[taught] >> np.uint64(1)).tolist())[k] for k in u.tolist()}
    got = lm.placed(s, n, spelled, size)
    assert [u.tolist() for _, u in got] == [np.unique(k >> np.uint64(1)).tolist() for k in keys]
    assert [p.tolist() for p, _ in got] == [p.tolist() for p in lm.places(keys, size)]


def test_memory_is_given_back_when_a_task_holds_no_batch(monkeypatch):
    class Big:
        pass

    def made():
        for _ in range(2):
            held = Big()
            live.append(weakref.ref(held))
            yield held

    live, seen = [], []
    monkeypatch.setattr(common, "give_back", lambda *used: seen.append((used, sum(r() is not None for r in live))))
    for b in common.giving_back(made(), "kept"):
        del b
    assert seen[-1] == (("kept",), 0) and len(seen) == 3


def test_stages_hand_texts_to_python_in_small_batches(spark):
    before = spark.conf.get(common.BATCH)
    try:
        for given, then in (("10000", common.TEXTS_AT_ONCE), ("0", common.TEXTS_AT_ONCE), ("500", 500)):
            spark.conf.set(common.BATCH, given)
            out = corpus_pipeline.tokens_stage(spark, spark.range(5000).selectExpr("id AS doc_id", "'a' AS text"), "")
            assert int(spark.conf.get(common.BATCH)) == then
        assert out.count() == 5000
    finally:
        spark.conf.set(common.BATCH, before)


def test_buckets_sort_runs_that_are_in_order_and_nodes_by_depth():
    r = random.Random(3)
    s, n = lm.symbols(["".join(r.choices("ab é\n", k=300)) for _ in range(5)])
    code, size = lm.prefix_code(np.bincount(lm.befores(s).astype(np.int64) * lm.SYMBOLS + s, minlength=lm.SYMBOLS**2))
    u = np.unique(lm.pair_keys(s, n, np.ones(len(s), np.uint64))[2] >> np.uint64(1))
    got, at, number = lm._nodes(u, code[lm.pairs_of(u)], size[lm.pairs_of(u)].astype(np.int64)).tolist(), 0, {}
    for key, pair in zip(u.tolist(), lm.pairs_of(u).tolist(), strict=True):
        for left in reversed(range(int(size[pair]))):
            # One number for each context and path to the bit, another one for any other.
            assert number.setdefault((key >> 9, int(code[pair]) >> left + 1), got[at]) == got[at]
            at += 1
    assert at == len(got) and sorted(number.values()) == list(range(len(number)))


def test_strings_are_cut_out_of_an_arrays_bytes():
    a = lm.pa.array([b"a", b"", b"\xff\x00b", b"cd"], lm.pa.binary())
    assert lm.strings(a) == a.to_pylist() and lm.strings(a[1:3]) == a[1:3].to_pylist() and lm.strings(a[:0]) == []
