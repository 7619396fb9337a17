"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from sparkseam.llm import bpe, decontaminate, embeddings, html, licences, lm, quality, simhash, suffixes, tokenfile
from sparkseam.llm.common import table

QUERIES = {
    "op1_decontamination": lambda spark, d: decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_licences": lambda spark, d: licences.scan(table(spark, d, "documents")),
    "op3_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op9_embeddings": lambda spark, d: embeddings.near_duplicates(table(spark, d, "embeddings")),
    "op4_quality": lambda spark, d: quality.scored(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_html": lambda spark, d: html.extracted(table(spark, d, "pages")),
    "op6_suffixes": lambda spark, d: suffixes.removed(table(spark, d, "documents")),
    "op7_lm": lambda spark, d: lm.scored(table(spark, d, "documents")),
    "op8_bpe": lambda spark, d: bpe.round_trip(table(spark, d, "documents")),
    "op10_tokenfile": lambda spark, d: tokenfile.stored(table(spark, d, "documents")),
}
ORACLE_SQL = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op2_licences": licences.ORACLE_SQL,
    "op6_suffixes": suffixes.ORACLE_SQL,
    "op9_embeddings": embeddings.ORACLE_SQL,
}
