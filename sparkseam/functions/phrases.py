"""Discovery phrases and search expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseam.functions import text as X

# Words left out of source searches, and terms too general to search for.
SEARCH_STOP_WORDS = "a an and are as at be best by can could do does for from get how i in is it looking me more my need not of on or our please recommend recommendation recommendations should that the this to too use way we what which with would you your".split()
GENERIC_TERMS = "better manual manually platform process service solution software system tool tools workflow".split()
# Dashboard language and what buyers say instead.
BUYER_LANGUAGE = (
    ("find buyers", "getting enough customers"),
    ("buyer intent", "people who are actively looking for help"),
    ("keyword noise", "irrelevant conversations"),
    ("qualified leads", "people ready to buy"),
    ("generate leads", "getting new customers"),
    ("lead generation", "getting new customers"),
    ("reddit", "public conversations"),
)
# The phrase of each query type, in canonical order.
TEMPLATES = (
    ("buyer_pain", "{buyer} struggling with {problem}"),
    ("urgent_failure", "{buyer} {problem} needs fixing today"),
    ("recommendation_request", "what do {buyer} use for {problem}"),
    ("manual_workflow_frustration", "handling {problem} manually takes too much time"),
    ("category_tool_search", "tool to make {problem} easier"),
    ("switching_trigger", "switching from our current way of handling {problem}"),
)


def first_words(c: Column, n: int = 14) -> Column:
    return F.array_join(F.slice(F.split(X.normalize_space(c), " "), 1, n), " ")


def buyer_language(c: Column) -> Column:
    """Operator shorthand, in lower or title case, in buyers' words; at most 14 words."""
    c = F.substring(X.normalize_space(c), 1, 280)
    for a, b in BUYER_LANGUAGE:
        c = F.replace(F.replace(c, F.lit(a), F.lit(b)), F.lit(a.title()), F.lit(b))
    return first_words(c)


def typed_phrases(buyer: Column, problem: Column) -> Column:
    """Array of (query_type, phrase) in canonical order, the first of phrases equal but for case; empty without both parts."""
    rows = []
    for kind, template in TEMPLATES:
        parts = [F.lit(x) if x not in ("{buyer}", "{problem}") else buyer if x == "{buyer}" else problem for x in template.replace("{", "|{").replace("}", "}|").split("|") if x]
        rows.append(F.struct(F.lit(kind).alias("query_type"), first_words(F.concat(*parts)).alias("phrase")))
    all_ = F.array(*rows)
    kept = F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, 1, i), lambda y: F.lower(y["phrase"]) == F.lower(x["phrase"])))
    return F.when((buyer != "") & (problem != ""), kept).otherwise(F.array().cast("array<struct<query_type:string,phrase:string>>"))


def compact_query(c: Column, most: int = 2) -> Column:
    """The first meaningful terms; else the first that are no stop words; else the text itself, clipped."""
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(X.TOKEN), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(SEARCH_STOP_WORDS))
    good = F.filter(terms, lambda t: ~t.isin(GENERIC_TERMS))
    some = F.slice(F.when(F.size(good) > 0, good).otherwise(terms), 1, max(1, min(5, most)))
    return F.when(F.size(some) > 0, F.array_join(some, " ")).otherwise(X.clip(X.normalize_space(c), 200))


def literal(c: Column) -> Column:
    """A quoted search literal."""
    return F.concat(F.lit('"'), F.replace(F.replace(X.normalize_space(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
