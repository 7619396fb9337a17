"""Verdicts and evidence: cached verdicts, direct evidence of queries in posts, sufficiency of free sources, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseam.functions import rules
from sparkseam.functions import text as X
from sparkseam.operators import keys, report


def cached(wanted: DataFrame, cache: DataFrame, on: list[str], same: list[str], updated: str, tie: str, value: str) -> DataFrame:
    """wanted with the value of its newest cache row, if that row agrees in `same` too; null otherwise.

    Only the newest row of a key counts: an older one that agrees is not taken. Null markers agree with nothing.
    """
    new = keys.latest(cache.select(*on, *same, updated, tie, value), on, F.col(updated).desc_nulls_last(), F.col(tie))
    new = new.select(*on, *[F.col(c).alias(f"_{c}") for c in same], F.col(value).alias("_value"))
    agree = F.lit(True)
    for c in same:
        agree = agree & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return wanted.join(new, on, "left").select(*wanted.columns, F.when(agree, F.col("_value")).alias(value))


def newest_agreeing(wanted: DataFrame, cache: DataFrame, on: list[str], same: list[str], updated: str, tie: str, value: str, newest: int = 5) -> DataFrame:
    """wanted with the value of the first among its key's newest cache rows that agrees in all of `same`; null if none does."""
    first = report.first_n(cache.select(*on, *same, updated, tie, value), on, newest, F.col(updated).desc_nulls_last(), F.col(tie))
    best = first.groupBy(*on, *same).agg(F.min_by(value, "rank").alias(value))
    return wanted.join(best, [*on, *same], "left").select(*wanted.columns, value)


def sentences(text: Column) -> Column:
    """Sentences of a text, ends and line breaks part them; white space is single, empty ones are left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: X.normalize_space(s)), lambda s: s != "")


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are computed once a row: the optimizer copies no generator into the expressions that use it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def direct_evidence(pairs: DataFrame, stop_words: list[str] = X.RESEARCH_STOP_WORDS, cap: int = 2000) -> DataFrame:
    """pairs (…, phrase, text) with match_method and excerpt: the phrase itself, else the first sentence that shares most of its
    tokens, if enough; other pairs are dropped. Candidates come from a join on tokens; pairs are judged row by row.

    Phrase, tokens and best sentence are computed once a pair; named in the sentences' lambda they would be for each sentence.
    """
    d = once(pairs, _p=F.lower(X.compact_term(F.col("phrase"))), _t=X.normalize_space(F.col("text"))).where("_p <> '' AND _t <> ''")
    d = once(d, _at=F.instr(F.lower("_t"), F.col("_p")) - 1, _wanted=X.tokens(F.col("_p"), stop_words))
    # The wanted tokens are distinct and free of stop words and single characters, so what they share with a sentence's is too.
    shared = lambda s: F.size(F.array_intersect("_wanted", F.regexp_extract_all(F.lower(s), F.lit(X.TOKEN), F.lit(0))))
    scored = F.transform(sentences(F.col("text")), lambda s, i: F.struct(shared(s).alias("n"), (-i).alias("i"), s.alias("s")))
    d = once(d, _best=F.when((F.col("_at") < 0) & (F.size("_wanted") > 0), F.array_max(scored)))
    enough = (F.col("_best.n") >= X.required_overlap(F.size("_wanted"))) & (F.col("_best.n") > 0)
    overlap = F.when(enough, F.trim(F.substring("_best.s", 1, cap)))
    d = d.withColumn("match_method", F.when(F.col("_at") >= 0, "exact_phrase").when(overlap.isNotNull(), "token_overlap"))
    d = d.withColumn("excerpt", F.when(F.col("_at") >= 0, rules.excerpt_around(F.col("_t"), F.col("_at"), F.length("_p"))).otherwise(overlap))
    return d.where("match_method IS NOT NULL").select(*pairs.columns, "match_method", "excerpt")


def ordered_evidence(evidence: DataFrame, limit: int = 30) -> DataFrame:
    """Exact phrases first, then by source, post and kind of query; the limit is kept within 1 and 100."""
    return evidence.orderBy(F.col("match_method") != "exact_phrase", "source", F.coalesce("source_post_id", F.lit("")), "query_type").limit(min(100, max(1, limit)))


def accepted_evidence(evidence: DataFrame, tenant: str, profile: str) -> DataFrame:
    """Accepted evidence of one tenant's profile whose excerpt its text holds word for word, whatever its length."""
    own = (F.col("tenant_id") == tenant) & (F.col("service_profile_id") == profile) & (X.status(F.col("evidence_status")) == "accepted")
    full = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("id", "source", "source_text", "evidence_excerpt")]
    return evidence.where(own & full[0] & full[1] & full[2] & full[3] & rules.is_verbatim(F.col("evidence_excerpt"), F.col("source_text"), 1))


def enough_free_evidence(hits: DataFrame, group: str, least_hits: int = 2, least_types: int = 3) -> DataFrame:
    """(group, sufficient) of hits (group, query_type, matchable): enough hits, one that can be matched, enough kinds of queries.

    Hits whose kinds are all untyped (legacy, empty) need no variety.
    """
    kind = F.nullif(F.trim("query_type"), F.lit(""))
    typed = F.count_distinct(F.when(kind != "legacy", kind))
    enough = (F.count("*") >= least_hits) & (F.count_if(F.col("matchable")) >= 1) & ((typed == 0) | (typed >= least_types))
    return hits.groupBy(group).agg(enough.alias("sufficient"))


def run_counters(rows: DataFrame, by: str) -> DataFrame:
    """Posts, embedded ones, cache misses, candidates, ready and discovery matches of each run, in one pass."""
    embedded = F.col("embedded")
    return rows.groupBy(by).agg(
        F.count("*").alias("posts"), F.count_if(embedded).alias("embedded"), F.count_if(~embedded).alias("cache_misses"), F.count_if(F.col("match_status").isNotNull()).alias("candidates"),
        F.count_if(F.col("match_status") == "ready_for_review").alias("ready"), F.count_if(F.col("match_status") == "discovery_candidate").alias("discovery"),
    )


def checkpoints(records: DataFrame, batch: str, created: str, id_: str) -> DataFrame:
    """The newest record of each batch (of equal times, the largest id), from which a sync goes on."""
    newest = F.max(F.struct(F.col(created).alias("created_ts"), F.col(id_).alias("last_id"))).alias("m")
    return records.groupBy(batch).agg(newest, F.count("*").alias("n")).select(batch, "m.created_ts", "m.last_id", "n")


def replaced(existing: DataFrame, incoming: DataFrame, by: str) -> DataFrame:
    """Delete, then insert: all rows of a group that incoming names give way to incoming's rows; null groups stay."""
    return existing.join(incoming.select(by).distinct(), by, "left_anti").select(incoming.columns).unionByName(incoming)


def vector_writes(existing: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Vectors (…, vector, status, error) after a run: a result with a vector completes its row, one without marks it failed
    and leaves the old vector in place."""
    old = existing.select(*on, F.col("vector").alias("_v"), F.col("status").alias("_s"), F.col("error").alias("_e"))
    new = results.select(*on, "vector", "error", F.lit(True).alias("_in"))
    done = F.col("vector").isNotNull()
    status = F.when(F.col("_in").isNull(), F.col("_s")).when(done, "completed").otherwise("failed")
    error = F.when(F.col("_in").isNull(), F.col("_e")).when(~done, F.coalesce("error", F.lit("unknown")))
    return old.join(new, on, "full_outer").select(*on, F.coalesce("vector", "_v").alias("vector"), status.alias("status"), error.alias("error"))


def merged_results(*sources: DataFrame, key: str, text: str, order: Column, least_chars: int = 20, cap: int = 80) -> DataFrame:
    """Results of several providers as one: the first of each key in the given order of providers, without short texts, cut to the cap."""
    out = None
    for n, s in enumerate(sources):
        s = s.withColumn("_provider", F.lit(n))
        out = s if out is None else out.unionByName(s)
    first = keys.latest(out.where(F.length(F.trim(text)) >= least_chars), [key], F.col("_provider"), order)
    return first.orderBy("_provider", order).limit(cap).drop("_provider")
