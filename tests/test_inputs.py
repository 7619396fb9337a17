from __future__ import annotations

from pyspark.sql import functions as F

from sparkseam.functions import inputs as I
from sparkseam.operators import outbox
from sparkseam.sources import sinks, tables


def value(spark, f, *args):
    return spark.range(1).select(f(*map(F.lit, args)).alias("v")).first()["v"]


def test_lists(spark):
    assert value(spark, I.string_list, "a, B\nb ,, c  d") == ["a", "B", "c d"]
    assert value(spark, I.string_list, None) == value(spark, I.string_list, " ,\n") == []
    assert value(spark, lambda c: I.json_list(c, 2, 3), '["abcd", " ABC ", "x", "y"]') == ["abc", "x"]
    assert value(spark, I.json_list, "no") == value(spark, I.json_list, None) == []
    assert value(spark, lambda c: I.watched_sources(c, ["x", "hackernews"], ["x"]), '["HN"]') == ["hackernews"]
    assert value(spark, lambda c: I.watched_sources(c, ["x", "hackernews"], ["x"]), None) == ["x"]
    assert value(spark, lambda a: I.legacy_terms(F.array(a, F.lit("abc")), F.lit(None).cast("array<string>"), most=1), "1 2 3 4 5 6 7 8 9") == ["1 2 3 4 5 6 7 8"]


def test_urls(spark):
    for url, want in [("X.org", "https://X.org/"), (" HTTP://a.b/c;d?e#f", "http://a.b/c"), ("http://a.b/c;d/e", "http://a.b/c;d/e"), ("ftp://a.b", None), ("https://", None), ("", None), (None, None)]:
        assert value(spark, I.normalized_url, url) == want
    assert [value(spark, I.safe_url, u) for u in (" https://a.b/?q ", "javascript:x", "https://", None, "http://" + "a" * 5000)] == ["https://a.b/?q", "", "", "", ""]
    assert value(spark, I.fallback_urls, "https://a.b/about/")[:3] == ["https://a.b/about", "https://a.b", "https://a.b/about-us"]


def test_times(spark):
    iso = lambda s: value(spark, lambda c: I.utc_timestamp(c).cast("string"), s)
    assert iso("2024-01-02T03:04:05Z") == iso("2024-01-02T05:04:05+02:00") == iso("1704164645") == iso("2024-01-02 03:04:05") == "2024-01-02 03:04:05"
    assert [iso(s) for s in ("soon", "2024-13-02", "", None)] == [None] * 4
    assert iso("2024") == "1970-01-01 00:33:44"


def test_clipped(spark):
    assert value(spark, lambda c: I.clipped(c, 3), "abc") == "abc"
    assert value(spark, lambda c: I.clipped(c, 3), "abcd") == "abc" + I.CLIPPED


def test_interventions(spark):
    now = F.lit("2025-01-01").cast("timestamp")
    emails = spark.createDataFrame([("t", 1, "queued", None), ("t", 2, "queued", None), ("u", 1, "queued", None)], "tenant string, user_id long, status string, next_retry_at timestamp")
    acts = [("t", 1, "suppress", 0, "a", 1), ("t", 1, "suppress", 0, "a", 2), ("t", 1, "cooldown", 3, "b", 3), ("t", 2, "suppress", 0, "old", 1), ("u", 1, "note", 0, "c", 1)]
    actions = spark.createDataFrame(acts, "tenant string, user_id long, action string, days int, key string, at long")
    got = outbox.intervene(emails, actions, spark.createDataFrame([("old",)], "key string"), now)
    assert sorted((r.tenant, r.user_id, r.status, str(r.next_retry_at)) for r in got.collect()) == [("t", 1, "cooldown", "2025-01-04 00:00:00"), ("t", 2, "queued", "None"), ("u", 1, "queued", "None")]


def test_archive_is_read_back(spark, tmp_path):
    sinks.archive(spark.createDataFrame([("a", 1), ("b", 2)], "day string, v long"), str(tmp_path / "x"), "day")
    got = tables.staged(spark, str(tmp_path / "x"), "v long")
    assert sorted((r.day, r.v, r._bad) for r in got.collect()) == [("a", 1, None), ("b", 2, None)]
