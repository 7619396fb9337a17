"""Decision rules as column expressions: routing, eligibility, access, failures, grounding. Times are compared with a given now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseam.functions import text as X

# Tokens of technical queries and of queries about commerce.
TECHNICAL = (
    "api backend bug bugs code coding database deploy deployment developer developers devops engineering frontend github infrastructure integration kubernetes observability repository sdk security server software stacktrace"
).split()
COMMERCE = "amazon commerce ecommerce etsy listing listings sales seller sellers seo shop store stores tags".split()
TECHNICAL_SOURCES = ("stackexchange", "github")
# Plans, billing states, provider states.
PAID_TIERS, ACTIVE, CANCELLED = ("pro", "enterprise"), ("active", "canceling"), ("canceling", "canceled", "cancelled")
MAIL_RETRY, MAIL_FINAL = (429, 500, 502, 503, 504), (400, 401, 403, 404, 422)
BUSY = (408, 409, 429)
READY = ("ready_for_review", "qualified")


def query_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(X.TOKEN), F.lit(0)))


def _any_of(c: Column, words: list[str]) -> Column:
    return F.arrays_overlap(query_tokens(c), F.array(*map(F.lit, words)))


def source_takes_query(source: Column, query: Column, technical_only: bool = False) -> Column:
    """Whether a source is asked a query: technical sources may be kept for technical ones (and commerce, at Stack Exchange)."""
    s = F.lower(F.trim(source))
    if not technical_only:
        return F.lit(True)
    return ~s.isin(*TECHNICAL_SOURCES) | ((s == "stackexchange") & _any_of(query, COMMERCE)) | _any_of(query, TECHNICAL)


def stackexchange_site(query: Column, configured: str = "") -> Column:
    """A configured site, else webmasters for queries about commerce, else stackoverflow."""
    site = X.normalize_space(F.lit(configured))
    return F.when(site != "", F.lower(site)).when(_any_of(query, COMMERCE), "webmasters").otherwise("stackoverflow")


def source_name(source: Column) -> Column:
    """Sources under one name each: twitter is x."""
    s = F.lower(F.trim(source))
    return F.when(s == "twitter", "x").otherwise(s)


def in_preferences(source: Column, preferences: Column) -> Column:
    """Whether a watchlist's preferred sources have this one; no preferences admit all."""
    return (F.coalesce(F.size(preferences), F.lit(0)) <= 0) | F.array_contains(F.transform(preferences, source_name), source_name(source))


def allowed_source(source: Column, allowed: list[str], supported: list[str]) -> Column:
    """Policy: a source that is both allowed and supported; unsupported ones are unsupported_sources()."""
    return source_name(source).isin(*(set(map(str.lower, allowed)) & set(map(str.lower, supported))))


def unsupported_sources(sources: Column, supported: list[str]) -> Column:
    return F.array_sort(F.array_except(F.transform(sources, source_name), F.array(*map(F.lit, supported))))


def embeddable_profile(status: Column, extraction: Column) -> Column:
    """Profiles that failed or are put away get no vector; unknown states do."""
    bad = F.coalesce(X.status(status), F.lit("")).isin("failed", "error", "archived", "deleted")
    return ~bad & ~F.coalesce(X.status(extraction), F.lit("")).isin("failed", "error")


def current_embedding(text: Column, kept_text: Column, model: Column, kept_model: Column, vector: Column) -> Column:
    """Whether the kept vector is of this text and model."""
    return F.coalesce((text == kept_text) & (model == kept_model), F.lit(False)) & vector.isNotNull()


def fresh_processing(status: Column, updated: Column, now: Column, seconds: int = 600) -> Column:
    return F.coalesce((X.status(status) == "processing") & (now < updated + F.make_dt_interval(secs=F.lit(seconds))), F.lit(False))


def on_radar(status: Column, done: list[str], created: Column, now: Column, days: int = 30) -> Column:
    """Open states stay on the radar, done ones for some days."""
    return ~F.coalesce(X.status(status), F.lit("")).isin(*done) | F.coalesce(created >= now - F.make_interval(days=F.lit(days)), F.lit(False))


def entitlement(plan: Column, status: Column, trial_ends: Column, period_end: Column, now: Column) -> Column:
    """struct(plan_tier, subscription_status, is_pro, is_canceling, billing_label) of a workspace.

    The period's end, else the trial's, bounds the access: a cancelled plan is paid until then, and an active one no longer.
    """
    named = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    tier = F.coalesce(named(plan), F.lit("free"))
    paid = tier.isin(*PAID_TIERS)
    state = F.coalesce(named(status), F.when(~paid, "free"))
    end = F.coalesce(period_end, trial_ends)
    ahead = F.coalesce(end > now, F.lit(False))
    cancelled = F.coalesce(state.isin(*CANCELLED), F.lit(False))
    active = F.when(cancelled, ahead).when((state == "active") & end.isNotNull() & ~ahead, False).otherwise(F.coalesce(state.isin(*ACTIVE), F.lit(False)))
    pro = paid & active
    label = F.when(pro & (tier == "enterprise"), "Enterprise").when(pro, "Pro").when(paid & F.coalesce(state == "past_due", F.lit(False)), "Payment Past Due").otherwise("Free Access")
    return F.struct(F.upper(tier).alias("plan_tier"), state.alias("subscription_status"), pro.alias("is_pro"), (pro & cancelled).alias("is_canceling"), label.alias("billing_label"))


def mail_outcome(code: Column) -> Column:
    """retryable or permanent; codes that say neither are tried again."""
    return F.when(code.isin(*MAIL_FINAL), "permanent").otherwise("retryable")


def failure_reason(error: Column, code: Column) -> Column:
    """Why a crawl failed, by the error's class and the provider's status code; either may be null."""
    name, client = F.coalesce(error, F.lit("")), F.coalesce(code.between(400, 499), F.lit(False))
    busy = F.coalesce(code.isin(*BUSY) | code.between(500, 599), F.lit(False))
    return (
        F.when(name.isin("TimeoutError", "TimeLimitExceeded"), "execution_timeout")
        .when(name.isin("RateLimitError", "APITimeoutError") | busy, "provider_backpressure")
        .when(client, "provider_request_rejected")
        .when(name == "ProfileExtractionSemanticError", "profile_semantic_validation_failed")
        .when(name.isin("ValidationError", "JSONDecodeError"), "schema_validation_failed")
        .otherwise("unhandled_exception")
    )


def retries_crawl(error: Column, code: Column) -> Column:
    """Semantic errors and requests that the provider rejects aren't repeated."""
    rejected = F.coalesce(code.between(400, 499) & ~code.isin(*BUSY), F.lit(False))
    return (F.coalesce(error, F.lit("")) != "ProfileExtractionSemanticError") & ~rejected


def _folded(c: Column, plain: bool = False) -> Column:
    """White space single and no case: capitals first, as a letter may become others by them (ß is SS), and one sigma for both.

    The optimizer drops capitals right inside small letters, so that the sigma's replacement stands between.
    plain: small letters one by one (ß is no SS) and plain white space, as DuckDB has them.
    """
    if plain:
        return X.plain_lower(X.plain_space(F.coalesce(c, F.lit(""))))
    return F.lower(F.translate(F.upper(F.coalesce(X.normalize_space(c), F.lit(""))), "Σ", "σ"))


def is_verbatim(excerpt: Column, source: Column, least_chars: int = 8, plain: bool = False) -> Column:
    """Whether the source holds the excerpt word for word; white space and case don't count, tiny excerpts do not pass."""
    x = _folded(excerpt, plain)
    return (F.length(x) >= least_chars) & F.contains(_folded(source, plain), x)


def is_named(phrase: Column, source: Column, plain: bool = False) -> Column:
    """The same for a short name, which needs two letters or digits of ASCII."""
    x = _folded(phrase, plain)
    return (F.length(F.regexp_replace(x, "[^a-z0-9]", "")) >= 2) & F.contains(_folded(source, plain), x)


def sanitized(verdict: Column, source: Column, plain: bool = False) -> Column:
    """A verdict (match, pain_theme, signal_type, urgency_level, urgency_reason, evidence_excerpt, purchase_stage, competitor_mention)
    with only those details that the source holds word for word; without a match, with none. plain: compared letter by letter."""
    match, space = F.coalesce(verdict["match"], F.lit(False)), X.plain_space if plain else X.normalize_space
    bare = lambda c: F.coalesce(space(verdict[c]), F.lit(""))
    urgent = match & is_verbatim(verdict["urgency_reason"], source, plain=plain)
    keep = lambda ok, c: F.when(ok, bare(c)).otherwise("").alias(c)
    return F.struct(
        verdict["match"].alias("match"), F.when(match, verdict["pain_theme"]).otherwise("").alias("pain_theme"), F.when(match, verdict["signal_type"]).alias("signal_type"),
        F.when(urgent, verdict["urgency_level"]).otherwise("none").alias("urgency_level"), keep(urgent, "urgency_reason"), keep(match & is_verbatim(verdict["evidence_excerpt"], source, plain=plain), "evidence_excerpt"),
        F.when(match, verdict["purchase_stage"]).alias("purchase_stage"), keep(match & is_named(verdict["competitor_mention"], source, plain), "competitor_mention"),
    )


def confirmed_match(status: Column, score: Column, executed: Column, match: Column, threshold: float = 0.55) -> Column:
    """A verifier-confirmed match: ready or qualified, of a finite score from the threshold on; unknown flags pass."""
    s = F.coalesce(F.lower(F.trim(status)).isin(*READY), F.lit(False))
    return s & F.coalesce((score >= threshold) & ~F.isnan(score) & (score < float("inf")), F.lit(False)) & F.coalesce(executed, F.lit(True)) & F.coalesce(match, F.lit(True))


def excerpt_around(text: Column, at: Column, length: Column, before: int = 500, after: int = 800, cap: int = 2000) -> Column:
    """The characters around a hit of `length` characters at `at` (from 0)."""
    left = F.greatest(F.lit(0), at - before)
    return F.substring(F.trim(F.substring(text, left + 1, at + length + after - left)), 1, cap)
