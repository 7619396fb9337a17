from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sparkseam.functions import phrases
from sparkseam.operators import discovery, outbox


def test_typed_phrases(spark):
    df = spark.createDataFrame([("small SaaS founders", "find buyers with less keyword noise on Reddit"), ("", "x"), (None, "x")], "b string, p string")
    got = [r.x for r in df.select(phrases.typed_phrases(phrases.buyer_language(F.coalesce("b", F.lit(""))), phrases.buyer_language(F.col("p"))).alias("x")).collect()]
    assert [x.query_type for x in got[0]] == [k for k, _ in phrases.TEMPLATES]
    assert all(len(x.phrase.split()) <= 14 for x in got[0])
    assert got[0][4].phrase == "tool to make getting enough customers with less irrelevant conversations on public conversations easier"
    assert got[1] == got[2] == []


def test_compact_query_falls_back(spark):
    df = spark.createDataFrame([("We need a better CRM for tracking deals",), ("the best tool",), ("of the",), (None,)], "t string")
    assert [r.x for r in df.select(phrases.compact_query(F.col("t")).alias("x")).collect()] == ["crm tracking", "tool", "of the", None]


def test_or_expression_keeps_whole_clauses(spark):
    df = spark.createDataFrame([(1, 1, 'say "x"'), (1, 2, "b" * 300), (1, 3, "c" * 200), (1, 4, "d"), (2, 1, "one"), (2, 2, " ")], "k int, o int, t string")
    got = {r.k: r.expression for r in discovery.or_expressions(df, "k", "o", "t").collect()}
    assert got == {1: '("say \\"x\\"" OR "' + "b" * 300 + '")', 2: '"one"'}


def test_paced_slots(spark):
    df = spark.createDataFrame([("a", 1, datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 50)], "k string, i int, ts timestamp")
    got = [r.slot for r in discovery.paced(df, "k", "ts", "i", 10).orderBy("ts").collect()]
    assert [g - got[0] for g in got] == [0, 10, 20, 50]


def test_scrub():
    doc = '{"Token": "t", "status": "ok", "note": "hello", "n": 1.5, "deep": {"a": {"b": {"c": {"d": 1}}}}, "l": [1, "x"], "bad": NaN}'
    got = discovery._scrub_json(doc)
    assert '"token": "[redacted]"' in got
    assert '"status": "ok"' in got
    assert "hello" not in got
    assert "[truncated]" in got
    assert discovery._scrub_json("broken") == discovery._scrub_json(None) == "{}"


def test_unsubscribe_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "t", " A@x ", "k1", "queued"), (2, "t", "a@x", "k2", "sent"), (3, "t", "a@X", "k3", "dispatch_failed"), (4, "u", "a@x", "k4", "queued")], "id int, tenant string, email string, token string, status string")
    none = spark.createDataFrame([], "tenant string, email string")
    tokens = spark.createDataFrame([("k1",), ("k1",), ("zz",)], "token string")
    s, o = outbox.unsubscribe(rows, none, tokens)
    assert sorted(tuple(r) for r in s.collect()) == [("t", "a@x")]
    assert {r.id: r.status for r in o.collect()} == {1: "suppressed", 2: "sent", 3: "suppressed", 4: "queued"}
    again = outbox.unsubscribe(o, s, tokens)
    assert again[0].count() == 1
    assert {r.id: r.status for r in again[1].collect()} == {1: "suppressed", 2: "sent", 3: "suppressed", 4: "queued"}


def test_or_expressions_drops_terms_that_cannot_fit_before_the_exchange(spark, capsys):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id DIV 3 AS o", "concat('t', id) AS t").repartition(7)
    got = discovery.or_expressions(df, "k", "o", "t", 60)
    got.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    for k, text in {r.k: r.expression for r in got.collect()}.items():
        rows, size, want = [(i // 3, f'"t{i}"') for i in range(5000) if i % 2 == k], 2 - 4, []
        for o in sorted({o for o, _ in rows}):
            same = sorted(c for p, c in rows if p == o)
            size += sum(len(c) + 4 for c in same)
            if size > 60:
                break
            want += same
        assert text == "(" + " OR ".join(want) + ")"
