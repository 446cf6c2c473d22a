import re

from pyspark.sql import functions as F

from corpusloom.llm import _spark


def test_spread_join_with_hot_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(_spark, "HOT", 5)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 60 + [2] * 30 + list(range(10, 40)) + [None])], "k long, i long")
    side = rows.where("k % 3 <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    total = rows.count()
    want = {(r.k, r.i, r.n, r.top) for r in rows.join(side, "k", "left").select("k", "i", "n", "top").collect()}
    got = _spark.spread_join(rows, side, ["k"], "n", ["i"], total, "left")
    assert got.columns == ["k", "i", "n", "top"] and {tuple(r) for r in got.collect()} == want and got.count() == total
    inner = _spark.spread_join(rows, side, ["k"], "n", ["i"], total)
    assert {tuple(r) for r in inner.collect()} == {w for w in want if w[2] is not None}


def test_spread_join_drops_repeated_rows_without_a_further_shuffle(spark, monkeypatch):
    monkeypatch.setattr(_spark, "HOT", 5)
    rows = spark.createDataFrame([(k, i % 7) for i, k in enumerate([1] * 60 + [2] * 30 + [*range(10, 40)] * 2)], "k long, i long")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.struct(F.max("i").alias("top")).alias("x"))
    joined = lambda once: _spark.spread_join(rows, side, ["k"], "n", ["i"], 150, once=once)
    got = joined(True)
    assert got.columns == ["k", "i", "n", "x"] and sorted(map(tuple, got.collect())) == sorted({tuple(r) for r in joined(False).collect()})
    above, below = joined(True)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")
    assert "HashAggregate" in above and "Exchange" not in above
    assert len(re.findall(r"Exchange hashpartitioning\(\w+#\d+L, _(?:l_)?away#", below)) == 2


def test_written_tables_and_their_folder(spark):
    t = _spark.written(spark.range(10), "numbers")
    assert t.count() == 10 and t._corpusloom_path.startswith(_spark.shared_dir(spark)) and _spark.shared_dir(spark).startswith("file:///")
    _spark.discard(t)
    _spark.discard(spark.range(1))
    assert not spark._jvm.org.apache.hadoop.fs.Path(t._corpusloom_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(t._corpusloom_path))
