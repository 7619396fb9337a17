"""Small cases of round 3's findings."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkseam.functions import rules
from sparkseam.plans import registry


def test_verdicts_as_the_sql_compares(spark, tmp_path):
    texts = [
        "Üß.&&& Sich*** schkeitlich", "xxStraßen", "ẞb ẞẞcd ẞ efgh", "ΑΒ ΟΔΟΣ ΑΒΓΔ", "ab İzmir Iıſ cdef", "not a quote", "　 a  b  cd\v\u0085ef gh ", "a b   cdef ghij  ",
        "\n\t a\x1c\x1fb\r\n\f cdef", "\U00010d50a\U00010d51 ᲉbꟋÅ \U00010400K µ", " " * 50_000 + "x", "ab" + "  " * 50_000 + "cd", "", " ", " ", "not a quote", "NOT  A\nQUOTE", None,
    ]
    r = np.random.default_rng(4)
    texts += ["".join(r.choice(list("abCßẞſıİŉﬁΣσςµKÅé̇ \u0085   　\v\n\t\x1c 1.😀Ᲊ\U00010d50"), r.integers(0, 45)).tolist()) for _ in range(1000)]
    keys = [None, -6, 2, 3, 6, 10, 15, 12, 30]  # each text under keys that meet different conditions
    spark.createDataFrame([(k, x) for x in texts for k in keys], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.QUERIES["sanitized_verdicts"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    duck.execute(f"CREATE TABLE want AS {registry.SQL['sanitized_verdicts']}")
    duck.execute(f"CREATE TABLE got AS FROM '{tmp_path}/out/*.parquet'")
    assert duck.execute("FROM want EXCEPT ALL FROM got").fetchall() == []
    assert duck.execute("FROM got EXCEPT ALL FROM want").fetchall() == []
    assert duck.execute("SELECT count(*) FROM want WHERE competitor_mention = 'Üß.&&&'").fetchall() == [(0,)]


def test_verbatim_with_and_without_full_folding(spark):
    rows = [("STRASSE", "die Straße"), ("straße", "Die STRAßE"), ("a b cdef", "A B CDEF"), ("οδος", "ΟΔΟΣ Α")]
    df = spark.createDataFrame(rows, "x string, s string").select(*(rules.is_verbatim(F.col("x"), F.col("s"), 1, plain=p).alias(str(p)) for p in (False, True)))
    assert [tuple(r) for r in df.collect()] == [(True, False), (True, True), (True, False), (True, False)]
    named = spark.createDataFrame([("Üß.", "Üß. Ja")], "x string, s string").select(rules.is_named(F.col("x"), F.col("s")).alias("a"), rules.is_named(F.col("x"), F.col("s"), plain=True).alias("b"))
    assert [tuple(r) for r in named.collect()] == [(True, False)]
