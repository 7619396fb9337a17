"""Small cases of round 2's findings."""

from __future__ import annotations

import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkseam.functions import inputs as I
from sparkseam.functions import rules
from sparkseam.functions import text as X
from sparkseam.operators import matching, outbox, verdicts
from sparkseam.plans import registry


def test_evidence_of_a_long_text_is_linear(spark):
    n = 4000
    text = ". ".join(f"Sentence {i} has apples and some more words here" for i in range(n)) + ". Ripe pears with green apples\nend"
    df = spark.createDataFrame([(text,)], "text string").select("text", F.concat_ws(" ", F.reverse(F.regexp_extract_all("text", F.lit("apples|green|pears"), F.lit(0)))).alias("phrase"))
    began = time.time()
    got = verdicts.direct_evidence(df).select("match_method", "excerpt").collect()
    assert [tuple(r) for r in got] == [("token_overlap", "Ripe pears with green apples")]
    assert time.time() - began < 15


def test_list_of_many_items_is_linear(spark):
    n = 6000
    text = ",".join(f"Item {i}" for i in range(n)) + ",ITEM 7, item  0\nlast,Last"
    df = spark.createDataFrame([(text,), (None,), (",\n ,",), ("b,a,B,c,A",)], "text string")
    began = time.time()
    got = [r.items for r in df.select(F.array_join(I.string_list(F.col("text")), "|").alias("items")).collect()]
    assert got == ["|".join(f"Item {i}" for i in range(n)) + "|last", "", "", "b|a|c"]
    assert time.time() - began < 15


def test_recall_of_many_queries(spark):
    v = np.random.default_rng(3).standard_normal((6000, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (7000, None), (7001, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    began = time.time()
    got = {(r.profile_id, r.rank): r.post_id for r in matching.recall_topk(df.where("id < 3000"), df, k=4, floor=0.15).collect()}
    assert time.time() - began < 25
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    m = np.round(u[:3000] @ u.T, 12)
    best = np.argsort(-m, axis=1, kind="stable")[:, :4]
    assert got == {(i, j + 1): int(best[i, j]) for i in range(3000) for j in range(4) if m[i, best[i, j]] >= 0.15}


def test_verbatim_ignores_case_of_every_letter(spark):
    rows = [("ERSSIE", "Herr Erßie", True), ("erßie", "HERR ERSSIE", True), ("ΟΔΟΣ", "οδος", True), ("οδοσ", "ΟΔΟΣ Α", True), ("ﬁrm", "FIRM", True), ("erze", "Erßie", False)]
    got = spark.createDataFrame(rows, "x string, s string, want boolean").select(rules.is_verbatim(F.col("x"), F.col("s"), 1).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_quota_windows_as_the_sql_rounds(spark, tmp_path):
    rows = [(1, 5, "2024-01-01 23:59:59.4"), (2, 5, "2024-01-01 23:59:59.5"), (3, 5, "2024-01-01 23:59:59.9"), (4, 5, "2024-01-02 00:00:00"), (5, 5, "2024-01-02 12:00:00"), (6, None, "2024-01-02 12:00:00"), (7, 5, "1969-12-31 23:59:59.7")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["quota_windows"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(duck.execute(registry.SQL["quota_windows"]).fetchall())
    assert [r[1] for r in got[:3]] == [1704067200, 1704153600, 1704153600]
    floor = {r.event_id: r.window_start for r in outbox.quota_windows(df, "user_id", "ts", "event_id", 86400, 3).collect()}
    assert floor[3] == 1704067200 and floor[7] == -86400


def test_redacted_contacts_as_the_sql_has_them(spark, tmp_path):
    texts = [
        "Des +1 (826) 555-4081 190.137.223.204 du", "555-123-4567 555-123-4568 555-123-4569", "a@b.com. Then x@y.org.", "ü@b.de éa.b@c.org_d a@b.com%c@d.org", "(555) 123-4567\n", "555\v123 4567 890",
        "a@b." + "c" * 70 + "@d.org", "x" * 200_000, "a." * 100_000 + "@", "\n555 123 4567\n\n555 123 4568", "é555-123-4567é 1-555-123-4567_", "@@a@@b.cc@d.ee", "", None,
    ]
    r = np.random.default_rng(5)
    texts += ["".join(r.choice(list("a1.@-+ (5)\n_é%"), 80, p=[0.1, 0.15, 0.1, 0.1, 0.1, 0.05, 0.1, 0.05, 0.1, 0.05, 0.02, 0.02, 0.03, 0.03]).tolist()) for _ in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.QUERIES["redact_contacts"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert duck.execute(f"({registry.SQL['redact_contacts']}) EXCEPT FROM '{tmp_path}/out/*.parquet'").fetchall() == []


def test_redacted_contacts_by_default_take_numbers_side_by_side(spark):
    df = spark.createDataFrame([("Des +1 (826) 555-4081 190.137.223.204 du",)], "t string")
    assert df.select(X.redact_contacts(F.col("t"))).first()[0] == "Des [phone removed] [phone removed] du"
