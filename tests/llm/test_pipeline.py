"""The pipeline's stages against plain Python on a small corpus, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

import corpus_pipeline
from sparkseam.llm import decontaminate, queries, simhash, suffixes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_licences", "op9_embeddings"])
def test_same_rows_as_sql(spark, tmp_path, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/o")
    c.execute(f"CREATE TABLE want AS {queries.ORACLE_SQL[name]}")
    cols = ",".join(x[0] for x in c.execute("DESCRIBE want").fetchall())
    assert c.execute(f"SELECT count(*) FROM (FROM want EXCEPT ALL SELECT {cols} FROM '{tmp_path}/o/*.parquet')").fetchall() == [(0,)]
    assert c.execute(f"SELECT count(*) FROM (SELECT {cols} FROM '{tmp_path}/o/*.parquet' EXCEPT ALL FROM want)").fetchall() == [(0,)]


def test_stages(spark):
    # The classifier needs some hundred labels: sf0.001 has 87.
    SF = "/root/testdata/sf0.01"  # noqa: N806
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], SF)))
        assert seen[-1].columns == columns
    raw, good, single, cut, clean = ({r.doc_id: r.text for r in d.collect()} for d in seen)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & good.keys()) <= 0.05 * len(bad)
    fine = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(fine & good.keys()) >= 0.98 * len(fine)
    assert raw.keys() > good.keys()
    groups = simhash.near_duplicates(seen[1]).collect()
    assert single.keys() == {r.doc_id for r in groups if r.doc_id == r.component_id}
    spans = {r.doc_id: r.kept_sha256 for r in suffixes.removed(seen[2]).collect()}
    assert cut.keys() == single.keys()
    assert all(hashlib.sha256(cut[i].encode()).hexdigest() == spans[i] for i in cut if cut[i].isascii())
    dirty = {r.doc_id for r in decontaminate.contamination(seen[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert clean.keys() == cut.keys() - dirty
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()}
    assert out == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__ as e

    assert {"pipeline", *queries.QUERIES} <= e.queries().keys()
