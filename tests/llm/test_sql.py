import os

import duckdb
import pytest

from corpusloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(rel.project(", ".join(cols)).fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_its_rows(spark, name):
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() == n or name.startswith("op1_")
