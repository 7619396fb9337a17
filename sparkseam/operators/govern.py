"""Governance: suppression, removal cascades, retention, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suppress(posts: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    """Posts that no removal names by any of the keys: one anti join per key, on non-empty values."""
    for k in keys:
        named = removals.select(k).where(F.col(k).isNotNull() & (F.col(k).cast("string") != "")).distinct()
        posts = posts.join(named, k, "left_anti")
    return posts


def suppress_removed(posts: DataFrame, removals: DataFrame) -> DataFrame:
    """Posts that no completed removal request of the same source names, by post id, author (whatever the case) or address.

    posts: (source, source_post_id, author_handle, url, …); posts without source or id are dropped, as nothing could name them.
    removals: (source, source_post_id, author_handle, source_url, status). One anti join per identity.
    """
    bare = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    d = posts.withColumns({"_source": F.lower(bare("source")), "_id": bare("source_post_id"), "_author": F.lower(bare("author_handle")), "_url": bare("url")})
    d = d.where("_source IS NOT NULL AND _id IS NOT NULL")
    done = removals.where("status = 'completed'")
    for own, other in (("_id", bare("source_post_id")), ("_author", F.lower(bare("author_handle"))), ("_url", bare("source_url"))):
        named = done.select(F.col("source").alias("_source"), other.alias(own)).where(F.col(own).isNotNull()).distinct()
        d = d.join(named, ["_source", own], "left_anti")
    return d.select(posts.columns)


def cascade(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Children whose parent is left."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def retained(df: DataFrame, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Rows not older than the retention time, which is kept within 7 and 90 days; rows without a time stay."""
    cut = now - F.make_interval(days=F.lit(min(90, max(7, days))))
    return df.where(F.col(ts).isNull() | (F.col(ts) >= cut))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children that name no parent: an audit of references; null references are none."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
