"""Every registered core query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sparkseam.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", registry.SQL)
def test_same_rows_as_sql(spark, duck, tmp_path, name):
    registry.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {registry.SQL[name]}")
    cols = ",".join(x[0] for x in duck.execute("DESCRIBE want").fetchall())
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT {cols} FROM '{tmp_path}/out/*.parquet'")
    assert duck.execute("SELECT column_name, column_type FROM (DESCRIBE want)").fetchall() == duck.execute("SELECT column_name, column_type FROM (DESCRIBE got)").fetchall()
    assert duck.execute("SELECT count(*) FROM (FROM want EXCEPT ALL FROM got)").fetchall() == [(0,)]
    assert duck.execute("SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)").fetchall() == [(0,)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
