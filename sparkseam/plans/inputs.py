"""Queries of input forms (lists, URLs, times), operators' actions and stream joins on the test tables; see registry.query()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.functions import inputs as I
from sparkseam.operators import outbox
from sparkseam.plans.registry import query
from sparkseam.streaming import jobs

SPACE = r"trim(regexp_replace({}, '[\s\x85\xA0 -     　 ]+', ' ', 'g'))"
FIRST = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


@query(
    "string_lists",
    f"""
WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,\\n]'), lambda x: {SPACE.format("x")}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string({FIRST.format("coalesce(l, [])")}, '|') AS items FROM c""",
)
def _(t, spark) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(I.string_list(F.col("text")), "|").alias("items"))


@query(
    "json_lists",
    """
SELECT doc_id, CASE WHEN source = 'src3' THEN '' WHEN lower(lang) = lower(source) THEN source ELSE left(source, 3) || CASE WHEN lang IS NULL THEN '' ELSE '|' || lang END END AS items,
CASE source WHEN 'src1' THEN 'hackernews,x' WHEN 'src2' THEN 'lemmy' ELSE 'bluesky,github' END AS sources FROM documents WHERE source IS NOT NULL""",
)
def _(t, spark) -> DataFrame:
    d = t("documents").where("source IS NOT NULL")
    items = F.when(F.col("source") == "src3", "{").otherwise(F.to_json(F.array(F.concat(F.lit(" "), F.left("source", F.lit(3))), F.upper(F.left("source", F.lit(3))), F.col("lang"))))
    names = F.when(F.col("source") == "src1", '["Twitter", "HN", "hacker_news"]').when(F.col("source") == "src2", '["LEMMY", "other"]').otherwise("[3, null]")
    known = ["hackernews", "x", "lemmy", "bluesky", "github"]
    return d.select("doc_id", F.array_join(I.json_list(items), "|").alias("items"), F.array_join(I.watched_sources(names, known, ["github", "bluesky"]), ",").alias("sources"))


@query(
    "legacy_terms",
    f"""
WITH c AS (SELECT doc_id, list_filter(list_transform([source, text, NULL, lang, upper(source)], lambda x: {SPACE.format("x")}), lambda x: length(x) >= 4) AS l FROM documents),
w AS (SELECT doc_id, list_transform(l, lambda x: array_to_string(string_split(x, ' ')[:8], ' ')) AS l FROM c)
SELECT doc_id, array_to_string({FIRST.format("l")}, '|') AS terms FROM w""",
)
def _(t, spark) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(I.legacy_terms(F.array("source"), F.array("text", F.lit(None)), F.array("lang"), F.array(F.upper("source"))), "|").alias("terms"))


@query("query_types", "SELECT user_id, string_agg(event_type, ',' ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS types FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('purchase', 'click', 'view')) GROUP BY 1")
def _(t, spark) -> DataFrame:
    e = t("events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("query_type"), F.lit("").alias("phrase"))).alias("q"))
    got = e.select("user_id", I.in_type_order(F.col("q"), ["purchase", "click", "view"]).alias("q")).where("size(q) > 0")
    return got.select("user_id", F.array_join(F.col("q.query_type"), ",").alias("types"))


@query(
    "page_urls",
    """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', ['s', 'h', 'p']) AS u FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN u.s IN ('http', 'https') THEN (CASE WHEN page_id % 5 = 1 THEN 'https' ELSE u.s END) || '://' || u.h || coalesce(nullif(regexp_replace(u.p, ';[^/]*$', ''), ''), '/') END AS normalized,
CASE WHEN page_id % 5 IN (0, 1) THEN '' ELSE url END AS safe,
array_to_string(list_transform(list_filter(['', '/about', '/about-us', '/company', '/pricing', '/plans', '/packages'], lambda x: TRUE), lambda x: u.s || '://' || u.h || x), ' ') AS fallback FROM p""",
)
def _(t, spark) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, "ftp://x.org/y").when(k == 1, F.regexp_replace("url", "^[a-z]+://", " ")).otherwise(F.col("url"))
    origin = F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0)
    return t("pages").select("page_id", I.normalized_url(url).alias("normalized"), I.safe_url(url).alias("safe"), F.array_join(I.fallback_urls(F.concat(origin, F.lit("/"))), " ").alias("fallback"))


@query("clipped_texts", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || E'\\n\\n[Content clipped by crawl payload guardrail.]' ELSE text END AS text, text IS NOT NULL AND contains(lower(text), 'the') OR coalesce(contains(lower(source), 'the'), false) AS mentions FROM documents")
def _(t, spark) -> DataFrame:
    return t("documents").select("doc_id", I.clipped(F.col("text"), 100).alias("text"), I.mentions(F.lit(" The "), F.col("text"), F.col("source")).alias("mentions"))


@query(
    "input_times",
    """
WITH e AS (SELECT event_id, event_id % 4 AS k, date_trunc('second', ts) AS s FROM events)
SELECT event_id, CASE k WHEN 1 THEN s - INTERVAL 2 HOUR WHEN 3 THEN NULL ELSE s END::TIMESTAMP AS parsed, CASE k WHEN 0 THEN s WHEN 1 THEN s - INTERVAL 2 HOUR ELSE TIMESTAMP '2025-01-01' END::TIMESTAMP AS or_now,
CASE WHEN k <> 3 THEN epoch(TIMESTAMP '2025-01-01')::BIGINT - epoch(s)::BIGINT + CASE k WHEN 1 THEN 7200 ELSE 0 END END AS age FROM e""",
)
def _(t, spark) -> DataFrame:
    k, s, now = F.col("event_id") % 4, F.date_trunc("second", F.col("ts").cast("timestamp")), F.lit("2025-01-01").cast("timestamp")
    iso = F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, F.unix_seconds(s).cast("string")).otherwise("soon")
    e = t("events").select("event_id", I.utc_timestamp(raw).alias("at"), I.timestamp_or(raw, now).alias("n"))
    return e.select("event_id", F.col("at").cast("timestamp_ntz").alias("parsed"), F.col("n").cast("timestamp_ntz").alias("or_now"), I.age_seconds(F.col("at"), now).alias("age"))


@query(
    "sync_windows",
    """
SELECT event_id, least(event_id * 600, CASE event_type WHEN 'click' THEN 86400 WHEN 'view' THEN 2592000 ELSE 604800 END)::BIGINT AS seconds,
(value < 50 AND event_id % 3 = 0) OR (value >= 100 AND (event_id % 2 = 0 OR event_id % 5 = 0)) AS polls, CASE event_type WHEN 'click' THEN 'good_fit' WHEN 'error' THEN 'wrong_buyer' ELSE event_type END AS feedback,
CASE WHEN event_type LIKE '%c%' THEN 'Mobile' ELSE 'Desktop' END AS device FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL""",
)
def _(t, spark) -> DataFrame:
    e, kind = t("events").where("value IS NOT NULL AND event_type IS NOT NULL"), F.col("event_type")
    stream = F.when(kind == "click", "charges").when(kind == "view", "customers").otherwise("other")
    polls = I.keep_polling(F.col("event_id") % 2 == 0, F.col("event_id") % 5, F.col("value") < 100, (F.col("value") < 50) & (F.col("event_id") % 3 == 0), F.when(F.col("value") < 20, F.lit(None)).otherwise(F.col("value")))
    feedback = I.renamed(F.when(kind == "click", "good_lead").when(kind == "error", "wrong_audience").otherwise(kind), I.FEEDBACK_ALIASES)
    agent = F.when(F.contains(kind, F.lit("c")), "X/5.0 Mobile Y").otherwise("X/5.0")
    return e.select("event_id", I.sync_window(stream, F.lit(0).cast("long"), F.col("event_id") * 600).alias("seconds"), polls.alias("polls"), feedback.alias("feedback"), I.device(agent).alias("device"))


@query(
    "manual_interventions",
    """
WITH a AS (SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('click', 'error') AND event_id % 7 <> 0),
l AS (SELECT user_id, arg_max(event_type, event_id) AS action, max(event_id) AS id FROM a GROUP BY 1)
SELECT c_custkey AS user_id, CASE action WHEN 'error' THEN 'suppressed' WHEN 'click' THEN 'cooldown' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'pending_dispatch' ELSE 'queued' END END AS status,
CASE WHEN action = 'click' THEN TIMESTAMP '2025-01-01' + (id % 9)::INTEGER * INTERVAL 1 DAY WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2025-01-01' END::TIMESTAMP AS next_retry_at,
CASE WHEN c_nationkey IS NULL OR c_nationkey % 3 = 0 THEN 'claimed' WHEN c_nationkey % 3 = 1 THEN 'already_claimed' ELSE 'taken' END AS claim FROM customer LEFT JOIN l ON c_custkey = user_id""",
)
def _(t, spark) -> DataFrame:
    now, tenant = F.lit("2025-01-01").cast("timestamp"), F.lit("t").alias("tenant")
    dead = F.col("c_custkey") % 3 == 0
    emails = t("customer").select(tenant, F.col("c_custkey").alias("user_id"), F.when(dead, "dead_lettered").otherwise("queued").alias("status"), F.when(dead, "dispatch").alias("failure_stage"), F.lit(None).cast("timestamp").alias("next_retry_at"), "c_nationkey")
    e = t("events").withColumn("key", F.col("event_id").cast("string"))
    act = F.when(F.col("event_type") == "error", "suppress").when(F.col("event_type") == "click", "cooldown").otherwise("note")
    actions = e.select(tenant, "user_id", act.alias("action"), (F.col("event_id") % 9).cast("int").alias("days"), "key", F.col("event_id").alias("at"))
    again = outbox.requeued(emails, emails, now)
    got = outbox.intervene(again, actions, e.where("event_id % 7 = 0").select("key"), now)
    holder = F.when(F.col("c_nationkey") % 3 == 1, "me").when(F.col("c_nationkey") % 3 == 2, "other")
    return got.select("user_id", "status", F.col("next_retry_at").cast("timestamp_ntz").alias("next_retry_at"), outbox.operator_claim(holder, F.lit("me")).alias("claim"))


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t, spark) -> DataFrame:
    # The delay is longer than the events' span, so that each key comes once whatever the batches.
    return jobs.distinct_within(spark, t("events"), ["user_id", "event_type"], "ts", "4000 days")


@query("stream_fan_out", "SELECT doc_id, s_suppkey AS profile_id FROM documents JOIN supplier ON source = 'src' || s_nationkey WHERE s_suppkey % 5 = 0 AND n_chars > 100 * s_suppkey")
def _(t, spark) -> DataFrame:
    profiles = t("supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("profile_id"), F.concat(F.lit("src"), "s_nationkey").alias("source"))
    return jobs.fan_out(spark, t("documents"), profiles, ["source"], lambda j: j.where("n_chars > 100 * profile_id").select("doc_id", "profile_id"))
