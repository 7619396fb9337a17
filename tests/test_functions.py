from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseam.functions import text as X
from sparkseam.operators import govern, keys, matching, outbox, report, web
from sparkseam.sources import sinks, tables


def one(spark, expr, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [(" a \n b ", "a b"), ("", ""), (None, None)])
def test_normalize_space(spark, text, want):
    assert one(spark, X.normalize_space(F.col("t")), t=text) == want


def test_tokens(spark):
    assert sorted(one(spark, X.tokens(F.col("t"), X.DISCOVERY_STOP_WORDS), t="The API-key of my api-key, x is lost")) == ["api-key", "lost"]
    assert one(spark, X.tokens(F.col("t"), X.RESEARCH_STOP_WORDS), t=None) == []
    assert len(X.DISCOVERY_STOP_WORDS) == 33
    assert len(X.RESEARCH_STOP_WORDS) == 24


@pytest.mark.parametrize(("text", "want"), [("short", "empty_or_too_short_text"), (None, "empty_or_too_short_text"), ("A LIMITED OFFER for everybody here", "cheap_filter_spam_signal"), ("a post that is long enough to keep", None)])
def test_cheap_filter(spark, text, want):
    assert one(spark, X.cheap_filter_reason(F.col("t")), t=text) == want


def test_redaction_mask_and_keys(spark):
    assert one(spark, X.redact_contacts(F.col("t")), t="mail a.b@c.org or +1 555 123 4567 now") == "mail [email removed] or [phone removed] now"
    assert one(spark, X.pii_mask(F.col("t")), t="") == ""
    assert one(spark, X.pii_mask(F.col("t")), t="x").startswith("***2d711642")
    assert one(spark, X.md5_percent(F.col("t")), t="ch_1") == 78
    assert one(spark, X.website_identity(F.col("t")), t="https://www.A.com:80/x/?q#f") == "a.com:80/x"
    assert one(spark, X.compact_term(F.col("t")), t="say \"hi\"  to, c# 'x'") == "say hi to c# x"


def test_overlap_rules(spark):
    rows = spark.range(1, 8).select(X.required_overlap(F.col("id")).alias("a"), X.required_share(F.col("id"), 0.15).alias("b"))
    assert [tuple(r) for r in rows.collect()] == [(1, 1), (2, 1), (2, 1), (2, 1), (3, 1), (3, 1), (3, 2)]


def test_match_status(spark):
    df = spark.createDataFrame([(True, True, "strong_match", 0.55), (True, True, "weak_match", 0.9), (True, False, "strong_match", 0.9), (None, True, "strong_match", 0.9), (True, True, "strong_match", 0.29)], "e boolean, m boolean, l string, s double")
    got = [r[0] for r in df.select(X.match_status(F.col("e"), F.col("m"), F.col("l"), F.col("s"))).collect()]
    assert got == ["ready_for_review", "discovery_candidate", "rejected", "rejected", "rejected"]


def test_buyer_context(spark):
    for text, want in (("Show HN: launching our guide", True), ("A tutorial: switching tools", False), ("Looking  for help", True), ("nothing here", False), (None, False), ("éus tools", False)):
        assert one(spark, X.has_buyer_context(F.col("t")), t=text) is want, text


def test_recall_topk_against_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((60, 4))
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0, float("nan"), 0.0, 0.0]), (102, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {(x.profile_id, x.post_id) for x in matching.recall_topk(df.where("id < 5"), df, k=3, floor=0.15).collect()}
    n = np.linalg.norm(v, axis=1)
    want = set()
    for p in range(5):
        s = [(-(v[p] @ v[q] / (n[p] * n[q]) if n[q] else 0.0), q) for q in range(60)]
        want |= {(p, q) for c, q in sorted(s)[:3] if -c >= 0.15}
    assert got == want


def test_single_profile_scores_a_quarter(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(2, [0.25, 0.9375**0.5])], "id long, embedding array<double>")
    assert matching.recall_topk(p, q).collect()[0].score == pytest.approx(0.25)


def test_exact_evidence_of_short_and_long_phrases(spark):
    q = spark.createDataFrame([(1, "manually chasing onboarding tasks"), (2, "pilots"), (3, None), (4, "")], "id long, text string")
    p = spark.createDataFrame([(10, "We are Manually  chasing onboarding tasks now."), (11, "copilots here"), (12, None)], "id long, text string")
    assert {(r.query_id, r.post_id, r["at"]) for r in matching.exact_evidence(q, p).collect()} == {(1, 10, 7), (2, 11, 2)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "qualified"), (2, "new")], "id long, s string")
    new = spark.createDataFrame([(1, "rejected"), (2, "ready"), (3, None)], "id long, s string")
    assert sorted((r.id, r.s) for r in keys.upsert(old, new, ["id"], "s", "qualified").collect()) == [(1, "qualified"), (2, "ready"), (3, None)]
    inc = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, n long")
    have = spark.createDataFrame([("b",)], "k string")
    assert sorted(r.n for r in keys.insert_ignore(have, inc, ["k"], F.col("n")).collect()) == [1, 3, 4]
    assert sorted(tuple(r) for r in keys.first_wins(inc, F.col("k"), "n").collect()) == [(1, 2), (3, 1), (4, 1), (5, 1)]


def test_suppression_by_any_identity(spark):
    p = spark.createDataFrame([(1, "ann", None), (2, "bob", "u"), (3, None, None), (4, "", "v")], "post long, author string, url string")
    r = spark.createDataFrame([(1, None, None), (None, "bob", None), (None, "", None)], "post long, author string, url string")
    assert sorted(x.post for x in govern.suppress(p, r, ["post", "author", "url"]).collect()) == [3, 4]


def test_outbox_outcomes(spark):
    c = spark.createDataFrame([("1", "a", " S@x "), ("2", "a", "t@x"), ("3", "a", "u@x"), ("4", "a", "v@x"), ("5", "a", "w@x"), ("", "a", "z@x"), ("6", "a", None)], "user_id string, campaign string, email string")
    now = F.expr("timestamp_ntz'2024-02-01'")
    sup = spark.createDataFrame([("s@x",)], "email string")
    con = spark.createDataFrame([("2", "a", datetime(2024, 1, 25)), ("4", "a", datetime(2023, 1, 1))], "user_id string, campaign string, at timestamp_ntz")
    que = spark.createDataFrame([("3", "a")], "user_id string, campaign string")
    got = {r.user_id: r.outcome for r in outbox.decide(c, sup, con, que, 1, now).collect()}
    assert got == {"1": "suppressed", "2": "cooldown", "3": "duplicate", "4": "claimed", "5": "rate_limited"}


def test_double_dispute_is_counted_twice_only_without_preaggregation(spark):
    ch = spark.createDataFrame([("c", datetime(2024, 1, 1, 5), 100, 0)], "id string, ts timestamp_ntz, amount long, refunded long")
    di = spark.createDataFrame([("c", 10), ("c", 20)], "charge string, amount long")
    assert report.revenue(ch, di, False).first().gross == 200
    assert report.revenue(ch, di, True).first().gross == 100


def test_patterns_need_two_distinct_matches(spark):
    m = spark.createDataFrame([("1", "Slow"), ("2", "slow"), ("3", "Other"), ("3", "other"), ("4", None)], "id string, label string")
    assert [tuple(r) for r in report.patterns(m).collect()] == [("Slow", 2)]


def test_web_functions():
    assert web.text_of("<p>a &amp; b</p><div>c<br>d</div>") == "a & b c d"
    assert web.text_of("a<b>b</b> &amp;lt;x&gt;<!-- no --> 1 < 2") == "ab <x> 1 < 2"
    assert web.text_of(None) == ""
    page = "<title>Tool</title><nav><p>inside</p></nav><h1>H 1</h1><template><p>no</p></template><li>one</li><p>one</p><p>Menu</p><p>ab</p><h3>Sub</h3><h4>not a block</h4>"
    assert web.hero_of(page) == "Tool\ninside\n# H 1\n- one\none\n## Sub"
    assert web.hero_of("<p>" + "</p><p>".join(f"block {k}" for k in range(40)) + "</p>").count("\n") == 31
    assert web.without_boilerplate("![i](u)\nKeep\nkeep\n\n\nAll rights reserved\n  End  \nTerms of Service\nMain navigation\nsubscribe") == "Keep\n\nEnd\nsubscribe"
    assert web.without_boilerplate("[![a](b)](c)x\n" + "copyright " * 20 + "\ndata:image/png;base64,AAAA") == "x\n" + ("copyright " * 20).strip()
    assert web.without_boilerplate(None) == ""


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, '[{"a": "x"}, {"a": null}]'), (2, None), (3, "broken")], "id long, doc string")
    assert sorted((r.id, r.a or "") for r in tables.recordset(df, "doc", "a string").collect()) == [(1, ""), (1, "x")]
    assert tables.with_columns(df, {"id": "string", "more": "int"}).first().asDict() == {"id": "1", "more": None}
    good, bad = sinks.split_bad(df, F.col("doc") == "broken")
    assert (good.count(), bad.count()) == (1, 2)
    sinks.archive(df, f"{tmp_path}/a", "id")
    assert spark.read.json(f"{tmp_path}/a").count() == 3
