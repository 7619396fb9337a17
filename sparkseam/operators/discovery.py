"""Discovery: record mappers, corpus lookups, search expressions, telemetry details."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseam.functions import phrases


def or_expressions(terms: DataFrame, key: str, order: str, term: str, most_chars: int = 400) -> DataFrame:
    """(key, expression): quoted terms in order, joined by OR, up to the first that would exceed the length; in brackets if several."""
    t = terms.where(F.trim(term) != "").select(key, order, phrases.literal(F.col(term)).alias("clause"))
    w = Window.partitionBy(key).orderBy(order)
    # A clause takes six characters at least: rows of a higher rank can't fit, and each task drops its own before they are dealt out.
    t = t.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= most_chars // 6 + 2).drop("_rank")
    several = F.count("*").over(Window.partitionBy(key)) > 1
    upto = F.sum(F.length("clause") + 4).over(w) - 4 + F.when(several, 2).otherwise(0)
    kept = t.withColumn("fits", upto <= most_chars).where("fits").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "clause"))).alias("l"))
    joined = F.array_join(F.col("l.clause"), " OR ")
    return kept.select(key, F.when(F.size("l") > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined).alias("expression"))


def charge(doc: Column) -> list[Column]:
    """Columns of a charge document: missing amounts 0, currency unknown, customer only if it is a string."""
    get = lambda k: F.get_json_object(doc, f"$.{k}")
    customer = F.from_json(doc, "customer string")["customer"]
    return [
        get("id").alias("id"), F.coalesce(get("amount").try_cast("long"), F.lit(0)).alias("amount"), F.coalesce(get("amount_refunded").try_cast("long"), F.lit(0)).alias("amount_refunded"),
        F.coalesce(F.nullif(get("currency"), F.lit("")), F.lit("unknown")).alias("currency"), F.when(~customer.startswith("{"), customer).alias("customer"), F.coalesce(get("paid").try_cast("boolean"), F.lit(False)).alias("paid"),
    ]


def hits_to_posts(hits: DataFrame) -> DataFrame:
    """(source_post_id, title, body, url) of search hits (id, tags, title, text, url): stories and comments, not deleted.

    A story without text has its title as body; a missing address is the item's page; // addresses become https.
    """
    is_story = F.array_contains("tags", "story")
    fit = (is_story | F.array_contains("tags", "comment")) & ~F.arrays_overlap("tags", F.array(F.lit("deleted"), F.lit("dead")))
    body = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.when(is_story, F.col("title")), F.lit(""))
    url = F.nullif(F.trim("url"), F.lit(""))
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    out = hits.where(fit).select(F.col("id").cast("string").alias("source_post_id"), "title", body.alias("body"), F.coalesce(F.when(is_story, url), page).alias("url"))
    return out.where((F.length("body") >= 2) & (F.col("source_post_id") != ""))


def unambiguous(posts: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has: lookups that name no source must not guess."""
    single = posts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return posts.join(single, key, "left_semi")


def paced(df: DataFrame, key: str, ts: str, id_: str, seconds: int) -> DataFrame:
    """df with slot (epoch seconds): each key's requests at least so far apart, none before its time.

    slot = max(time, slot before + seconds) unrolls to a running maximum of time - seconds * place.
    """
    w = Window.partitionBy(key).orderBy(ts, id_)
    place = F.row_number().over(w) * seconds
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    df = df.withColumn("_p", place).withColumn("_a", at - F.col("_p"))
    return df.withColumn("slot", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_p")).drop("_p", "_a")


def shallow_merge(old: Column, new: Column) -> Column:
    """Map with the entries of both; new's win."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


# Keys of telemetry details that are never kept, and keys whose plain strings are.
SENSITIVE_KEYS = frozenset("api_key authorization author body content cookie email message password phrase post prompt query response secret source_post_data source_post_json source_post text title token url website".split())
PLAIN_KEYS = frozenset("cache_status error_code error_type model outcome phase provider reason reason_code skip_reason source stage status".split())


def scrubbed(value: object, key: str = "", depth: int = 0, deepest: int = 4, most: int = 40) -> object:
    """A detail without customers' content: sensitive keys, deep levels and unknown strings are replaced."""
    if key.lower() in SENSITIVE_KEYS:
        return "[redacted]"
    if depth >= deepest:
        return "[truncated]"
    if isinstance(value, dict):
        return {k.lower()[:96]: scrubbed(v, k.lower()[:96], depth + 1) for k, v in list(value.items())[:most] if k.strip()}
    if isinstance(value, list):
        return [scrubbed(v, key, depth + 1) for v in value[:most]]
    if isinstance(value, str):
        short = " ".join(value.split())[:240]
        if key.lower() in PLAIN_KEYS and re.fullmatch(r"[A-Za-z0-9_.:/-]{1,120}", short):
            return short
        return {"sha256": hashlib.sha256(short.encode()).hexdigest(), "length": len(value)}
    return value


def _scrub_json(doc: str | None) -> str:
    try:
        value = json.loads(doc or "{}", parse_constant=lambda _: None)
    except ValueError:
        value = {}
    return json.dumps(scrubbed(value) if isinstance(value, dict) else {}, sort_keys=True)


@F.pandas_udf(T.StringType())
def scrub(c: pd.Series) -> pd.Series:
    """JSON details, scrubbed; what is no JSON object becomes {}."""
    return c.map(_scrub_json)
