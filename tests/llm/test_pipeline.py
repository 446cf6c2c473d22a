import os
import random

import corpus_pipeline as C
from corpusloom.llm import pieces
from tests.llm import test_forest, test_lines
from tests.llm.test_forest import prose

SAMPLE = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    """Each stage's result from its own input, as plain Python has it."""
    rnd = random.Random(8)
    items = [(i, " ".join(prose(rnd, 30))) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        w = prose(rnd, rnd.randint(20, 80))
        bad = i % 9 == 0
        if bad:
            w[3] = "vile"
        if i % 17 == 1:
            w += items[i % 5][1].split()
        if i % 10 == 2 and i > 10:
            w = docs[i - 5][1].split(" ")[:] + ["tail"]
        t = " ".join(w)
        if i % 7 == 3:
            t = t + "\nshared one\nshared two\nshared three\nown %d" % i
        docs.append((i, t, "en", "s", 0, "x"))
        labels.append((i, 1, int(bad)))
    docs += [(1000, None, "en", "s", 0, "x"), (1001, "", "en", "s", 0, "x"), (1002, docs[4][1], None, None, None, "x"), (None, "lonely text without an id", "en", "s", 0, "x"), (None, "lonely text without an id", "en", "s", 0, "y"), (7, docs[7][1], "en", "s", 0, "x")]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, rid string").selectExpr("*", "7 AS _doc", "7 AS _tkey", "7 AS doc", "7 AS tkey", "7 AS row", "7 AS key", "7 AS item_words").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in C.STAGES:
        rows = [tuple(r)[:2] for r in now.collect()]
        cols = now.columns
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        got = [r.asDict() for r in now.collect()]
        if name == "toxicity":
            want = [(i, t) for i, t in rows if "vile" not in (t or "").split()]
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
        elif name == "line_dedup":
            want = [(r[0], r[3]) for r in test_lines.brute(rows) if r[2] == 0 or r[3].strip()]
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
            assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got)
        elif name == "near_dedup":
            groups = test_forest.brute(rows)
            want = sorted({i for i, n, c in groups if i is not None and (n == 0 or i == c)})
            assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == want
            assert sum(r["doc_id"] is None for r in got) == 1
        elif name == "decontamination":
            leaked = {i for i, t in rows if any(x in (t or "") for _, x in items)}
            assert leaked and {r["doc_id"] for r in got} == {i for i, _ in rows} - leaked
        else:
            assert sorted(((r["doc_id"], r["decoded"]) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
            coder = pieces.encoder(pieces.default_model())
            assert all(r["ids"] == coder.encode([r["decoded"]])[0].tolist() for r in got)
        if name != "encoding":
            assert now.columns == cols
        seen.append(len(got))
    assert seen == sorted(seen, reverse=True)
    assert C.run(spark, d).count() == seen[-1]


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert C.run(spark, d).count() == 0


def test_sample_tables(spark):
    if os.path.isdir(SAMPLE):
        out = C.run(spark, SAMPLE)
        assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "decoded"} and 100 < out.count() < 200
