"""The corpus pipeline: five stages from raw documents to token ids, each a function (spark, docs, sf_dir) -> DataFrame.

Stages filter or rewrite; all but the last return the columns of documents. doc_id is the key. A null text stays null and
counts as empty; a row without doc_id can't be named by a filter, so that the second and fourth stage keep it. Each stage
sets the session to hand texts to Python in small batches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.llm import bpe, decontaminate, quality, simhash, suffixes
from sparkseam.llm.common import maybe_broadcast, table, texts_at_once, written


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        texts_at_once(spark)
        return stage(spark, docs, sf_dir)

    return begin


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the smallest doc_id."""
    groups = simhash.near_duplicates(docs)
    dropped = written(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(maybe_broadcast(dropped), "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings out of each text that an earlier document holds too."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    dropped = written(found.where("contaminated").select("doc_id").distinct())
    return docs.join(maybe_broadcast(dropped), "doc_id", "left_anti").select(docs.columns)


@in_small_batches
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: The classifier, fingerprints and encoder are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
