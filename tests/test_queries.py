import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans.oracles import ORACLES
from corpusloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert len(rows) == 200
        return
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(ORACLES[name])
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    want = sorted(rel.project(", ".join(cols)).fetchall(), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == want


@pytest.mark.parametrize("name", ["deflated_bounds", "minhash_shape"])
def test_odd_texts_against_sql(spark, tmp_path, name):
    rows = list(enumerate(["", None, "a", "", None, "one two three four five six", "word " * 20000, "six five four three two one", "x" * 70000, "..."]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLES[name])
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_shapes_sign_each_text_once(spark):
    assert QUERIES["minhash_shape"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and len(df.columns) == 11
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
