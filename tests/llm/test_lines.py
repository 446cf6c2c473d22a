import random

import duckdb
from pyspark.sql import functions as F

from corpusloom.llm import lines as L


ORDER = {}


def docs_in_order(rows):
    """Documents by id and, of one id, by the hash that the operator orders them by."""
    return sorted({(2**63 - 1 if i is None else i, t) for i, t in rows if t is not None}, key=lambda d: (d[0], ORDER.get(d[1], 0), d[1]))


def brute(rows, n=3):
    """Removed lines by plain scanning, in order of (id, line)."""
    first, cover = {}, {}
    for i, t in docs_in_order(rows):
        xs = [(x.strip(" \t\r"), p) for p, x in enumerate(t.split("\n"))]
        xs = [(x, p) for x, p in xs if x]
        for k in range(len(xs) - n + 1):
            key = tuple(x for x, _ in xs[k : k + n])
            if first.setdefault(key, (i, t, k)) != (i, t, k):
                cover.setdefault((i, t), set()).update(range(xs[k][1], xs[k + n - 1][1] + 1))
    out = []
    for i, t in rows:
        gone = cover.get((2**63 - 1 if i is None else i, t), set())
        xs = [] if t is None else t.split("\n")
        out.append((i, len(xs), len([p for p in range(len(xs)) if p in gone]), None if t is None else "\n".join(x for p, x in enumerate(xs) if p not in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    clash = dict.fromkeys(("_key", "_doc", "_tkey", "_spans", "_cut", "doc", "tkey", "row", "cut", "spans", "a.b"), 7)
    df = df.withColumns({k: F.lit(v) for k, v in clash.items()})
    ORDER.update({r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()})
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "_lines"] and out.where("_key <> 7 OR doc <> 7 OR spans <> 7 OR row <> 7 OR `a.b` <> 7").isEmpty()
    got = out.selectExpr("doc_id", "_lines.n_lines n", "_lines.n_removed r", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_cases(spark):
    check(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "a \n\n b\nc\t"), (7, "q\n" * 10), (8, "1\n2\n1\n2\n1\n2"), (None, "a\nb\nc"), (9, "\n".join(map(str, range(20000)))), (10, "\n".join(map(str, range(5, 20000))))])


def test_repeated_rows_and_empty_table(spark):
    check(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])
    check(spark, [(None, "p\nq\na\nb\nc"), (None, "x\ny\nz\nu\nv"), (None, "a\nb\nc"), (3, "a\nb\nc\nd\ne"), (3, "k\nl\nm\na\nb\nc")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.dedup_lines(df).count() == 0


def test_random(spark):
    rnd = random.Random(1)
    check(spark, [(i, "\n".join(rnd.choice(["a", "b", "c", "", " d"]) for _ in range(rnd.randint(0, 9)))) for i in range(80)])


def test_sql_agrees(spark):
    rnd = random.Random(2)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", " d"]) for _ in range(rnd.randint(0, 9)))) for i in range(60)] + [(90, None)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(L.OP3_SQL).fetchall(), key=str) == brute(rows)
