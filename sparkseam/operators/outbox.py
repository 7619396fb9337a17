"""Outbox, quota and lease decisions as pure functions of rows and a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(candidates: DataFrame, suppressed: DataFrame, contacted: DataFrame, queued: DataFrame, quota: int, now: Column, cooldown_days: int = 14) -> DataFrame:
    """(user_id, campaign, outcome) of each distinct candidate: suppressed, cooldown, duplicate, rate_limited or claimed.

    candidates: (user_id, campaign, email); suppressed: (email); contacted: (user_id, campaign, at); queued: (user_id,
    campaign). Candidates without id, e-mail or campaign are left out; of equal ones that of the smallest e-mail counts. The
    quota admits the first by (user_id, campaign): ranks are added up over ordered ranges, not in one task.
    """
    c = candidates.where("trim(user_id) <> '' AND trim(email) <> '' AND trim(campaign) <> ''").groupBy("user_id", "campaign").agg(F.min(F.lower(F.trim("email"))).alias("email"))
    recent = contacted.where(F.col("at") >= now - F.make_interval(days=F.lit(cooldown_days))).select("user_id", "campaign").distinct()
    flag = lambda d, name: d.distinct().withColumn(name, F.lit(True))
    c = c.join(flag(suppressed.select("email"), "s"), "email", "left").join(flag(recent, "r"), ["user_id", "campaign"], "left").join(flag(queued.select("user_id", "campaign"), "q"), ["user_id", "campaign"], "left")
    c = c.withColumn("outcome", F.when(F.col("s"), "suppressed").when(F.col("r"), "cooldown").when(F.col("q"), "duplicate").otherwise("pending")).select("user_id", "campaign", "outcome")
    pending = c.where("outcome = 'pending'")
    admitted = pending.orderBy("user_id", "campaign").limit(max(quota, 0)).select("user_id", "campaign", F.lit(True).alias("ok"))
    return c.join(admitted, ["user_id", "campaign"], "left").select("user_id", "campaign", F.when(F.col("outcome") != "pending", F.col("outcome")).when(F.col("ok"), "claimed").otherwise("rate_limited").alias("outcome"))


def quota_windows(events: DataFrame, key: str, ts: str, id_: str, seconds: int, limit: int, nearest: bool = False) -> DataFrame:
    """events with window_start (epoch) and allowed: the first `limit` of a key's fixed window, by time and id.

    A window goes by a time's whole second: the one it is in, or the nearest one (a half to the even one).
    """
    at = F.col(ts).cast("timestamp")
    second = F.rint(F.unix_micros(at) / 1e6).cast("long") if nearest else F.unix_seconds(at)
    start = second - F.pmod(second, F.lit(seconds))
    w = Window.partitionBy(key, "window_start").orderBy(F.col(ts).asc_nulls_last(), F.col(id_).asc_nulls_last())
    return events.withColumn("window_start", start).withColumn("allowed", F.row_number().over(w) <= limit)


def claim(outbox: DataFrame, now: Column, limit: int, lease_minutes: int = 15) -> DataFrame:
    """The oldest eligible rows of (id, status, failure_stage, next_retry_at, lease_expires_at, created_at, attempt), leased."""
    past = lambda c, strict: F.col(c).isNull() | ((F.col(c) < now) if strict else (F.col(c) <= now))
    ready = F.col("status").isin("pending_dispatch", "dispatch_failed") & ((F.col("status") != "dispatch_failed") | (F.col("failure_stage") == "dispatch"))
    some = outbox.where(ready & past("next_retry_at", False) & past("lease_expires_at", True)).orderBy("created_at", "id").limit(max(limit, 0))
    return some.select("id", F.lit("dispatch_claimed").alias("status"), (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"), (now + F.make_interval(mins=F.lit(lease_minutes))).alias("lease_expires_at"))


def lease_outcome(status: Column, lease_expires_at: Column, now: Column) -> Column:
    """What a claim of a dispatch token gives: new, completed, in flight, or taken over from a dead worker."""
    return F.when(status.isNull(), "claimed").when(status == "completed", "completed").when(lease_expires_at >= now, "in_flight").otherwise("reclaimed")


def cooled(df: DataFrame, key: str, ts: str, id_: str, seconds: int) -> DataFrame:
    """df with admitted: rows at least so long after the key's row before (by time and id)."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, id_))
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    return df.withColumn("admitted", before.isNull() | (gap >= seconds))


def unsubscribe(outbox: DataFrame, suppressions: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suppressions, outbox) after the tokens' owners unsubscribed: their addresses are suppressed, their open rows too.

    outbox: (id, tenant, email, token, status), suppressions: (tenant, email), tokens: (token).
    """
    gone = outbox.join(tokens.select("token").distinct(), "token", "left_semi").select("tenant", F.lower(F.trim("email")).alias("email")).where("email <> ''").distinct()
    rows = outbox.withColumn("_e", F.lower(F.trim("email"))).join(gone.select("tenant", F.col("email").alias("_e"), F.lit(True).alias("_g")), ["tenant", "_e"], "left")
    open_ = F.col("status").isin("pending_dispatch", "queued", "dispatch_claimed", "dispatching", "dispatch_failed")
    done = rows.withColumn("status", F.when(F.col("_g") & open_, "suppressed").otherwise(F.col("status"))).select(outbox.columns)
    return suppressions.select("tenant", "email").union(gone).distinct(), done


def qualified(status: Column) -> Column:
    """Status after a human qualification: only what is ready becomes qualified; all else stays."""
    return F.when(status == "ready_for_review", "qualified").otherwise(status)


def intervene(emails: DataFrame, actions: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """emails (tenant, user_id, status, next_retry_at, ...) after operators' actions, each key once: suppress or cooldown.

    actions: (tenant, user_id, action, days, key, at); done: (key) of earlier ones, which aren't applied again. Of several on
    an account the last by (at, key) decides; other actions are only logged.
    """
    new = actions.join(done.select("key"), "key", "left_anti").where(F.col("action").isin("suppress", "cooldown"))
    first = new.groupBy("key").agg(F.min_by(F.struct("tenant", "user_id", "action", "days", "at"), F.struct("at", "tenant", "user_id")).alias("a")).select("key", "a.*")
    last = first.groupBy("tenant", "user_id").agg(F.max_by(F.struct("action", "days"), F.struct("at", "key")).alias("_a"))
    j = emails.join(last, ["tenant", "user_id"], "left")
    status = F.when(F.col("_a.action") == "suppress", "suppressed").when(F.col("_a.action") == "cooldown", "cooldown").otherwise(F.col("status"))
    retry = F.when(F.col("_a.action") == "cooldown", now + F.make_interval(days=F.col("_a.days"))).otherwise(F.col("next_retry_at"))
    return j.withColumn("status", status).withColumn("next_retry_at", retry).select(emails.columns)


def operator_claim(holder: Column, operator: Column) -> Column:
    """What an operator's claim of an account gives: claimed, already_claimed (by them) or taken (by another)."""
    return F.when(holder.isNull(), "claimed").when(holder == operator, "already_claimed").otherwise("taken")


def requeued(emails: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """emails (tenant, user_id, status, failure_stage, next_retry_at, ...) with the accounts' dead letters pending again."""
    j = emails.join(accounts.select("tenant", "user_id", F.lit(True).alias("_again")).distinct(), ["tenant", "user_id"], "left")
    dead = F.col("_again") & (F.col("status") == "dead_lettered")
    new = {"next_retry_at": F.when(dead, now).otherwise(F.col("next_retry_at")), "failure_stage": F.when(~F.coalesce(dead, F.lit(False)), F.col("failure_stage")), "status": F.when(dead, "pending_dispatch").otherwise(F.col("status"))}
    return j.withColumns(new).select(emails.columns)
