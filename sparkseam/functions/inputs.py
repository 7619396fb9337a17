"""Column expressions for inputs of uncertain form: lists, URLs, timestamps, labels. Null inputs give what the functions state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseam.functions import text as X

# Other names of sources, older names of feedback, the notice of a cut text, a stream's longest window in days.
SOURCE_ALIASES = {"hn": "hackernews", "hacker_news": "hackernews", "twitter": "x"}
FEEDBACK_ALIASES = {"good_lead": "good_fit", "bad_lead": "not_relevant", "wrong_audience": "wrong_buyer", "useful_not_now": "useful_pain_not_now"}
CLIPPED = "\n\n[Content clipped by crawl payload guardrail.]"
WINDOW_DAYS = {"charges": 1, "invoices": 1, "subscriptions": 7, "disputes": 7, "customers": 30}
FALLBACK_PATHS = ("/about", "/about-us", "/company", "/pricing", "/plans", "/packages")


def renamed(c: Column, names: dict[str, str]) -> Column:
    """c, or the name it stands for; null stays null."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[c], c)


def distinct_ignoring_case(items: Column) -> Column:
    """Items that aren't empty, white space normalised, the first of those that differ in case only; empty for null.

    Sorted, so that equal ones are neighbours: the work on a list of n items grows with n log n.
    """
    clean = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), X.normalize_space), lambda x: x != "")
    keyed = F.sort_array(F.transform(clean, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    # The list of one list binds the sorted one to a variable; named in the inner lambda, it would be made again for each item.
    first = F.transform(F.array(keyed), lambda s: F.filter(s, lambda y, j: (j == 0) | (F.get(s, j - 1)["k"] != y["k"])))[0]
    return F.transform(F.sort_array(F.transform(first, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])


def string_list(c: Column) -> Column:
    """Parts of a text between commas and line ends."""
    return distinct_ignoring_case(F.split(c, "[,\n]"))


def json_list(c: Column, most: int = 12, chars: int = 180) -> Column:
    """The first items of a JSON array, each cut; empty for null and anything else."""
    items = F.from_json(c, "array<string>")
    return F.slice(distinct_ignoring_case(F.transform(items, lambda x: F.left(X.normalize_space(x), F.lit(chars)))), 1, most)


def watched_sources(c: Column, known: list[str], default: list[str]) -> Column:
    """Sorted known sources of a JSON array, under one name each; the default ones if there are none."""
    named = F.transform(json_list(c, len(known), 32), lambda x: renamed(F.lower(x), SOURCE_ALIASES))
    some = F.array_sort(F.array_intersect(named, F.array(*map(F.lit, known))))
    return F.when(F.size(some) > 0, some).otherwise(F.array(*map(F.lit, sorted(default))))


def legacy_terms(*groups: Column, most: int = 8, words: int = 8) -> Column:
    """Search terms from arrays of phrases, in their order: of 4 characters or more, their first words, distinct."""
    every = F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in groups))
    long = F.filter(F.transform(every, X.normalize_space), lambda x: F.length(x) >= 4)
    return F.slice(distinct_ignoring_case(F.transform(long, lambda x: F.array_join(F.slice(F.split(x, " "), 1, words), " "))), 1, most)


def in_type_order(items: Column, order: list[str]) -> Column:
    """Structs (query_type, phrase) of known types in the types' order; equal types stay as they were."""
    at = F.array(*map(F.lit, order))
    keyed = F.transform(items, lambda x, i: F.struct(F.array_position(at, x["query_type"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.filter(keyed, lambda s: s["k"] > 0)), lambda s: s["x"])


def normalized_url(c: Column) -> Column:
    """An http URL without parameters, query and fragment, / for no path; https if it names no scheme; null for all else."""
    url = F.when(F.contains(F.trim(c), F.lit("://")), F.trim(c)).otherwise(F.concat(F.lit("https://"), F.trim(c)))
    part = lambda k: F.regexp_extract(url, r"^(?i:(https?))://([^/?#]+)([^?#]*)", k)
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), part(2), F.when(path == "", "/").otherwise(path)))


def safe_url(c: Column, most: int = 4096) -> Column:
    """An http URL with a host, trimmed; empty for null, long ones and other schemes."""
    url = F.trim(c)
    return F.when((F.length(url) <= most) & url.rlike(r"^(?i:https?)://[^/?#]"), url).otherwise("")


def fallback_urls(url: Column) -> Column:
    """The page, its site and the site's usual pages about itself, without closing slashes, distinct."""
    origin = F.regexp_extract(url, "^[^:/?#]+://[^/?#]*", 0)
    return F.array_distinct(F.transform(F.array(url, origin, *(F.concat(origin, F.lit(p)) for p in FALLBACK_PATHS)), lambda u: F.regexp_replace(u, "/+$", "")))


def clipped(c: Column, most: int = 500_000) -> Column:
    """A text of at most so many characters, and the notice if it was longer."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(CLIPPED))).otherwise(c)


def utc_timestamp(c: Column) -> Column:
    """Time of a string: epoch seconds or ISO, UTC if it names no zone; null for junk. The session's zone must be UTC."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))
    return F.when(s.rlike(r"^-?\d{1,11}(\.\d+)?$"), s.try_cast("double").try_cast("timestamp")).otherwise(iso)


def timestamp_or(c: Column, now: Column) -> Column:
    """Time of an ISO string, or the given one."""
    return F.coalesce(F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(c).try_cast("timestamp")), now)


def age_seconds(at: Column, now: Column) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(at)


def sync_window(stream: Column, since: Column, until: Column) -> Column:
    """Seconds of the next synchronisation: from since to until, less for streams that change often."""
    days = F.coalesce(F.create_map(*(F.lit(x) for pair in WINDOW_DAYS.items() for x in pair))[stream], F.lit(7))
    return F.least(until - since, (days * 86400).cast("long"))


def keep_polling(warming: Column, ready: Column, terminal: Column, verifying: Column, age_seconds_: Column) -> Column:
    """Whether a report is asked again: within five minutes of a final one while it is verified; else until it is final or has rows."""
    window = verifying & (age_seconds_.isNull() | (age_seconds_ < 300))
    return window | (~terminal & (warming | (ready == 0)))


def device(user_agent: Column) -> Column:
    return F.when(F.contains(user_agent, F.lit("Mobi")), "Mobile").otherwise("Desktop")


def mentions(needle: Column, *fields: Column) -> Column:
    """Whether a text occurs in one of the fields, in any case; an empty one does."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lower(F.trim(F.coalesce(needle, F.lit("")))))
