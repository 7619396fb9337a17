"""Records of public sources and of billing: staged JSON documents (one a row, in a column `doc`) to rows of one shape.

A document that can't be parsed, or whose post isn't fit to keep, gives no row; null documents give none either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseam.functions import text as X
from sparkseam.operators import web

# Words of probable spam in posts, and the form of a post's address at the AT protocol.
SPAM = r"(?i)\b(?:buy\s+now|casino|crypto\s+giveaway|free\s+followers|viagra)\b"
AT_POST = r"^at://([^/]+)/app\.bsky\.feed\.post/([^/?#]+)$"
OPT_OUT = "!no-unauthenticated"
POST = ("source_post_id", "author_handle", "title", "body", "url", "posted_at", "language")


def _text(c: Column) -> Column:
    return F.coalesce(X.normalize_space(c), F.lit(""))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def safe_http_url(c: Column) -> Column:
    """The trimmed address if it is http or https with a host and of at most 4,096 characters; else empty."""
    u = F.trim(c)
    return F.when((F.length(u) <= 4096) & u.rlike(r"^https?://[^/?#]"), u).otherwise("")


def utc_time(c: Column) -> Column:
    """Time of an ISO text (UTC where it names no zone) or of epoch seconds as digits; null for anything else."""
    return F.when(c.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double"))).otherwise(F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(c).try_cast("timestamp")))


def is_probable_spam(c: Column) -> Column:
    return c.rlike(SPAM)


def quoted(c: Column, *kept: str) -> Column:
    """Percent-encoded as a part of an address; letters, digits, _.-~ and `kept` stay."""
    out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for k in kept:
        out = F.replace(out, F.lit(f"%{ord(k):02X}"), F.lit(k))
    return out


def _kept(df: DataFrame, since: int, *conditions: Column) -> DataFrame:
    """The post columns of rows whose body and time are fit: two characters or more, no spam, not before `since`."""
    fit = (F.length("body") >= 2) & ~is_probable_spam(F.col("body")) & (F.unix_seconds("posted_at") >= since) & (F.col("url") != "") & (F.col("source_post_id") != "")
    for c in conditions:
        fit = fit & c
    return df.where(fit).select(*POST)


def _parsed(docs: DataFrame, schema: str) -> DataFrame:
    return docs.select(F.from_json("doc", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def bluesky_posts(docs: DataFrame, since: int = 0) -> DataFrame:
    """Posts by address of the post; authors or posts that opt out of the public web are dropped; the link names the DID where known."""
    label = "array<struct<val: string>>"
    d = _parsed(docs, f"uri string, record struct<text: string, createdAt: string, langs: array<string>>, author struct<handle: string, did: string, labels: {label}>, labels {label}, langs array<string>, indexedAt string")
    uri, body = _text(F.col("uri")), X.clip(_text(F.col("record.text")), 20_000)
    out = [F.coalesce(F.exists(c, lambda x: F.coalesce(_text(x["val"]) == OPT_OUT, F.lit(False))), F.lit(False)) for c in (F.col("labels"), F.col("author.labels"))]
    profile = F.coalesce(_filled(_text(F.col("author.did"))), F.regexp_extract(uri, AT_POST, 1))
    link = F.concat(F.lit("https://bsky.app/profile/"), quoted(profile, ":"), F.lit("/post/"), quoted(F.regexp_extract(uri, AT_POST, 2)))
    language = F.get(F.filter(F.transform(F.coalesce("langs", "record.langs"), _text), lambda x: x != ""), F.lit(0))
    rows = d.where(uri.rlike(AT_POST) & F.col("record").isNotNull() & ~out[0] & ~out[1]).select(
        uri.alias("source_post_id"), _filled(_text(F.col("author.handle"))).alias("author_handle"), X.clip(body, 1000).alias("title"), body.alias("body"), link.alias("url"),
        F.coalesce(utc_time(F.col("record.createdAt")), utc_time(F.col("indexedAt"))).alias("posted_at"), X.clip(F.coalesce(language, F.lit("en")), 64).alias("language"),
    )
    return _kept(rows, since)


def stackexchange_posts(docs: DataFrame, site: str, since: int = 0) -> DataFrame:
    """Questions by site and number; HTML of titles and bodies becomes text, a missing body is the title."""
    d = _parsed(docs, "question_id string, title string, body string, creation_date string, link string, owner struct<display_name: string>")
    title = X.clip(web.html_to_text("title"), 1000)
    rows = d.select(
        F.when(F.trim("question_id") != "", F.concat(F.lit(f"{site}:"), F.trim("question_id"))).otherwise("").alias("source_post_id"), _filled(_text(F.col("owner.display_name"))).alias("author_handle"),
        _filled(title).alias("title"), F.coalesce(_filled(X.clip(web.html_to_text("body"), 20_000)), title).alias("body"), safe_http_url(F.col("link")).alias("url"), utc_time(F.col("creation_date")).alias("posted_at"),
        F.lit(None).cast("string").alias("language"),
    )
    return _kept(rows, since)


def titled_body(title: Column, body: Column) -> Column:
    """Title, blank line, body: those of the two that aren't empty, clipped."""
    return X.clip(F.concat_ws("\n\n", _filled(title), _filled(body)), 20_000)


def github_issues(docs: DataFrame, since: int = 0) -> DataFrame:
    """Public issues, no pull requests; the body begins with the title."""
    d = _parsed(docs.where(F.get_json_object("doc", "$.pull_request").isNull()), "id string, title string, body string, created_at string, html_url string, user struct<login: string>, repository struct<private: boolean, visibility: string>")
    title = X.clip(_text(F.col("title")), 1000)
    public = ~F.coalesce(F.col("repository.private"), F.lit(False)) & (F.lower(_text(F.col("repository.visibility"))) != "private")
    rows = d.where(public).select(
        F.coalesce(F.trim("id"), F.lit("")).alias("source_post_id"), _filled(_text(F.col("user.login"))).alias("author_handle"), _filled(title).alias("title"),
        titled_body(title, X.clip(_text(F.col("body")), 18_500)).alias("body"), safe_http_url(F.col("html_url")).alias("url"), utc_time(F.col("created_at")).alias("posted_at"), F.lit("en").alias("language"),
    )
    return _kept(rows, since, F.col("url").rlike(r"(?i)^https?://(?:www\.)?github\.com(?:[:/?#]|$)"))


def lemmy_posts(docs: DataFrame, root: str, since: int = 0) -> DataFrame:
    """Post views of an instance at `root` (scheme and host); deleted, removed and adult posts are dropped."""
    d = _parsed(docs, "post struct<id: string, name: string, body: string, published: string, published_at: string, ap_id: string, deleted: boolean, removed: boolean, nsfw: boolean>, community struct<nsfw: boolean>, creator struct<name: string>")
    gone = F.coalesce("post.deleted", F.lit(False)) | F.coalesce("post.removed", F.lit(False)) | F.coalesce("post.nsfw", F.lit(False)) | F.coalesce("community.nsfw", F.lit(False))
    id_, title, home = F.coalesce(F.trim("post.id"), F.lit("")), X.clip(_text(F.col("post.name")), 1000), _filled(safe_http_url(F.col("post.ap_id")))
    host = root.split("//", 1)[-1].split(":")[0]
    rows = d.where(F.col("post").isNotNull() & ~gone & (id_ != "")).select(
        F.concat(F.lit("post:"), F.coalesce(home, F.concat(F.lit(f"{host}:"), id_))).alias("source_post_id"), _filled(_text(F.col("creator.name"))).alias("author_handle"), _filled(title).alias("title"),
        titled_body(title, X.clip(_text(F.col("post.body")), 18_500)).alias("body"), F.coalesce(home, F.concat(F.lit(f"{root}/post/"), id_)).alias("url"),
        F.coalesce(utc_time(F.col("post.published_at")), utc_time(F.col("post.published"))).alias("posted_at"), F.lit("en").alias("language"),
    )
    return _kept(rows, since)


def tweets(docs: DataFrame, users: DataFrame, since: int = 0) -> DataFrame:
    """Tweets with their authors' names: a left join, so that a tweet of an unknown author stays; users: (id, username), ids unique."""
    d = _parsed(docs, "id string, text string, created_at string, author_id string, lang string").withColumn("author", F.coalesce(F.trim("author_id"), F.lit("")))
    u = users.select(F.trim("id").alias("author"), _filled(F.trim(F.regexp_replace("username", "^@+", ""))).alias("name"))
    body, id_ = _text(F.col("text")), F.coalesce(F.trim("id"), F.lit(""))
    link = F.when(F.col("name").isNotNull(), F.concat(F.lit("https://x.com/"), F.col("name"), F.lit("/status/"), id_)).otherwise(F.concat(F.lit("https://x.com/i/web/status/"), id_))
    rows = d.join(u, "author", "left").select(
        id_.alias("source_post_id"), F.coalesce("name", _filled(F.col("author"))).alias("author_handle"), F.substring(body, 1, 160).alias("title"), body.alias("body"), link.alias("url"),
        utc_time(F.col("created_at")).alias("posted_at"), F.coalesce(_filled(F.trim("lang")), F.lit("en")).alias("language"),
    )
    return _kept(rows, since)


def social_posts(rows: DataFrame) -> DataFrame:
    """Stored rows under their present or former column names as posts, with the text for matching and the key for duplicates.

    Rows without source, id or body are dropped.
    """
    have = lambda *names: F.coalesce(*(_filled(F.trim(F.col(n).cast("string"))) for n in names if n in rows.columns), F.lit(None).cast("string"))
    out = rows.select(
        have("source").alias("source"), have("source_post_id").alias("external_id"), F.coalesce(have("title"), F.lit("")).alias("title"), have("body", "text").alias("text"),
        have("author_handle", "author").alias("author"), have("url").alias("url"), have("posted_at", "published_at").alias("published_at"),
    ).where("source IS NOT NULL AND external_id IS NOT NULL AND text IS NOT NULL")
    matching = F.trim(F.concat_ws("\n\n", _filled(F.col("title")), "text"))
    return out.withColumns({"matching_text": matching, "dedupe_key": F.concat_ws(":", "source", "external_id")})


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def _id_only(c: Column) -> Column:
    """A reference that is a plain id; an expanded object is none."""
    return F.when(~c.startswith("{"), c)


def _changed() -> Column:
    updated = F.col("updated").try_cast("long")
    return F.when(updated != 0, updated).otherwise(_number(F.col("created"))).alias("updated_ts")


def subscriptions(docs: DataFrame) -> DataFrame:
    """The first item's price, else its plan, else the subscription's own plan, gives amount and interval."""
    price = "struct<amount: string, interval: string>"
    d = _parsed(docs, f"id string, created string, updated string, customer string, status string, current_period_start string, current_period_end string, plan {price}, items struct<data: array<struct<price: {price}, plan: {price}>>>")
    first = F.get("items.data", F.lit(0))
    own = F.coalesce(first["price"], first["plan"], F.col("plan"))
    return d.select(
        "id", _number(F.col("created")).alias("created"), _changed(), _id_only(F.col("customer")).alias("customer"), "status", _number(F.col("current_period_start")).alias("current_period_start"),
        _number(F.col("current_period_end")).alias("current_period_end"), _number(own["amount"]).alias("plan_amount"), F.coalesce(own["interval"], F.lit("month")).alias("plan_interval"),
    )


def customers(docs: DataFrame) -> DataFrame:
    d = _parsed(docs, "id string, created string, updated string, email string, name string, phone string")
    return d.select("id", _number(F.col("created")).alias("created"), _changed(), "email", "name", "phone")


def invoices(docs: DataFrame) -> DataFrame:
    d = _parsed(docs, "id string, created string, updated string, customer string, subscription string, status string, amount_due string, amount_paid string, currency string, period_start string, period_end string")
    amounts = [_number(F.col(c)).alias(c) for c in ("amount_due", "amount_paid", "period_start", "period_end")]
    return d.select("id", _number(F.col("created")).alias("created"), _changed(), _id_only(F.col("customer")).alias("customer"), "subscription", "status", F.coalesce(_filled(F.col("currency")), F.lit("unknown")).alias("currency"), *amounts)


def disputes(docs: DataFrame) -> DataFrame:
    """The charge's id, whether the charge is named or there as an object."""
    d = _parsed(docs, "id string, created string, charge string, amount string, currency string, reason string, status string")
    charge = F.when(F.col("charge").startswith("{"), F.get_json_object("charge", "$.id")).otherwise(F.col("charge"))
    return d.select("id", _number(F.col("created")).alias("created"), charge.alias("charge"), _number(F.col("amount")).alias("amount"), F.coalesce(_filled(F.col("currency")), F.lit("unknown")).alias("currency"), "reason", "status")


def billing_events(docs: DataFrame) -> DataFrame:
    """Events for change capture: what happened to which object; the whole document stays as event_data."""
    d = docs.select("doc", F.from_json("doc", "id string, created string, type string, api_version string, data struct<object: struct<id: string, object: string>>").alias("r")).where("r IS NOT NULL")
    return d.select("r.id", _number(F.col("r.created")).alias("created"), "r.type", "r.api_version", F.col("r.data.object.id").alias("object_id"), F.col("r.data.object.object").alias("object_type"), F.col("doc").alias("event_data"))


#: Mapper and columns with personal data, by stream.
STREAMS: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "subscriptions": (subscriptions, ()), "customers": (customers, ("email", "phone", "name")), "invoices": (invoices, ()), "disputes": (disputes, ()), "events": (billing_events, ()),
}


def stream_rows(docs: DataFrame, stream: str, masked: bool = True) -> DataFrame:
    """A stream's documents as rows, personal data masked."""
    mapper, personal = STREAMS[stream]
    rows = mapper(docs)
    return rows.withColumns({c: X.pii_mask(F.col(c)) for c in personal}) if masked and personal else rows
