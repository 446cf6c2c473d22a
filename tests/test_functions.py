import math
import random
import re
import string
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import functions as fn
from corpusloom import namespace, operators, sources
from corpusloom.functions import _regex
from corpusloom.functions._parts import in_parts, runs
from corpusloom.functions.compression import deflated
from corpusloom.functions.fasttext import EOS, HS, MAGIC, OVA, Model, _tree, fnv, folded
from corpusloom.functions.minhash import SEED, P61, affine61, minima, permutations, signature
from corpusloom.functions.repetition import batch_signals, field_names, token_signals
from corpusloom.functions.scrub import scrubbed
from corpusloom.plans.queries import word_level, write_model

EDGE = [None, "", "a", "two words", "... !!!", "\n\n", "café", "café", "हिन्दी", "\U0001f600 x", "12345", "word " * 20000]


def texts(spark, rows=EDGE):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")


def column(spark, build, rows=EDGE):
    return [r.x for r in texts(spark, rows).select("id", build.alias("x")).orderBy("id").collect()]


def plain_signals(words, num_top, num_dup):
    """The definitions, by counting tuples."""
    total = max(1, sum(map(len, words)))
    out = []
    for n in range(1, num_dup + 1):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        if n <= num_top:
            count = Counter(grams)
            out.append(max((c * sum(map(len, g)) for g, c in count.items()), default=0) / total)
        else:
            seen, cover = set(), set()
            for i, g in enumerate(grams):
                if g in seen:
                    cover.update(range(i, i + n))
                seen.add(g)
            out.append(sum(len(words[i]) for i in cover) / total)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "é"]), max_size=40), st.integers(0, 4), st.integers(4, 10))
def test_repetition_matches_definitions(words, top, dup):
    assert token_signals(words, top, dup) == pytest.approx(plain_signals(words, top, dup))


@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "bb", "é", "日本"]), max_size=14)), max_size=8), st.integers(0, 4), st.integers(4, 8))
def test_batches_of_texts_have_the_signals_of_each(rows, top, dup):
    want = [[0.0] * dup if w is None else token_signals(w, top, dup) for w in rows]
    assert batch_signals(pa.array(rows, pa.list_(pa.string())), top, dup).tolist() == want


def test_repetition_columns(spark):
    r = column(spark, fn.repetition_signals("text"))
    assert list(r[2].asDict()) == field_names(4, 10)
    assert all(v is None for v in r[0]) and all(v == 0 for v in r[1]) and r[2].top_1_gram_char_ratio == 1.0 and r[11].dup_10_gram_char_ratio > 0.99
    assert len(column(spark, fn.repetition_signals("text", num_top=2, num_dup=3))[0]) == 3
    assert spark.range(2).select(fn.repetition_signals(F.lit("a"), num_top=0, num_dup=0).alias("r")).collect() == [((),), ((),)]
    for bad in ({"num_top": 5, "num_dup": 4}, {"num_top": 1, "num_dup": 0}, {"num_top": 0, "num_dup": -1}):
        with pytest.raises(ValueError):
            fn.repetition_signals("text", **bad)


def test_the_repeated_text_leads_every_signal(spark):
    rows = ["Rain fell on the roof all night while the town was asleep.", "Morgonen var kall och himlen klar över byn.", "Le sol brilla super le campo e le aves canta.", None, "One line that comes again and again. " * 10]
    df = operators.unnest(texts(spark, rows).withColumn("r", fn.repetition_signals("text")), "r")
    names = operators.columns_ending(df, "gram_char_ratio")
    assert len(names) == 10 and operators.maxima_at(df, names, F.col("id") == 4) and not operators.maxima_at(df, names, F.col("id") == 0)
    assert operators.first_row(df, "id").id == 0


def test_minhash_shapes_and_constants(spark):
    got = column(spark, fn.minhash("text"))
    empty = "76e8f1cf2904c31a3670d5180e381a96" * 14
    assert got[0] is None and got[1] == got[2] == got[3] == empty and len(got[11]) == 448 and got[11] != empty
    assert column(spark, fn.minhash("text", bsize=1, buckets=3))[1] == "f" * 48
    assert [r.x for r in texts(spark).select(fn.bucket(fn.minhash("text"), 13).alias("x")).collect()][11] == got[11][-32:]
    for bad in ({"seed": b"x"}, {"buckets": 0}, {"bsize": 0}, {"window": 0}, {"hash_family": "crc"}):
        with pytest.raises(ValueError):
            fn.minhash("text", **bad)


def test_affine_is_exact():
    rnd = random.Random(1)
    top = int(P61)
    xs = [0, 1, top - 1, *(rnd.randrange(top) for _ in range(300))]
    rnd.shuffle(ys := list(xs))
    rnd.shuffle(zs := list(xs))
    got = affine61(np.array(xs, np.uint64), np.array(ys, np.uint64), np.array(zs, np.uint64))
    assert got.tolist() == [(a * x + b) % top for a, b, x in zip(xs, ys, zs)]


def test_minima_are_exact_next_to_the_modulus():
    rnd, top = random.Random(8), int(P61)
    odd = [0, 1, 2, top - 1, top - 2, 2**31 - 1, 2**31, 2**60]
    pick = lambda: rnd.choice(odd) if rnd.random() < 0.4 else rnd.randrange(top)
    for n in [0, 1, 1, 2, 3, 256, 257, 1025] * 40:
        a, b, x = [max(1, pick()) for _ in range(4)], [pick() for _ in range(4)], [pick() for _ in range(n)]
        if n and rnd.random() < 0.5:
            # Remainders just below the modulus, and at 0.
            x = [(rnd.choice([top - 1, top - 2, 0]) - b[k % 4]) * pow(a[k % 4], -1, top) % top for k in range(n)]
        got = minima(*(np.array(v, np.uint64) for v in (a, b, x)))
        assert got.tolist() == [min(((p * v + q) % top for v in x), default=2**64 - 1) for p, q in zip(a, b)]


def test_minhash_estimates_jaccard():
    rnd = random.Random(2)
    a, b, seed = permutations(SEED, 512)
    x = [str(rnd.randrange(10**6)) for _ in range(400)]
    y = x[:300] + [str(rnd.randrange(10**6)) for _ in range(100)]
    sign = lambda w: signature(w, a, b, seed, 512, 1, 1, "xxh3")
    p, q = sign(x), sign(y)
    same = np.mean([p[i : i + 16] == q[i : i + 16] for i in range(0, len(p), 16)])
    assert abs(same - len(set(x) & set(y)) / len(set(x) | set(y))) < 0.08


def test_compression(spark):
    size, ratio = column(spark, fn.compressed_size("text")), column(spark, fn.compression_ratio("text"))
    assert size[:3] == [None, 0, 1] and ratio[0] is None and math.isnan(ratio[1]) and ratio[2] == 1.0 and ratio[11] > 100
    assert deflated(b"abc" * 9, 6) == len(zlib.compress(b"abc" * 9, 6)) - 6 - 2
    assert column(spark, fn.compressed_size("text", level=0))[11] > 100_000
    for level in (-1, 10):
        with pytest.raises(ValueError):
            fn.compressed_size("text", level=level)


def test_stored_blocks_and_streams_of_long_texts():
    raw = bytes(random.Random(6).choice(b"abc de") for _ in range(300_000))
    for n in (0, 1, 32767, 32768, 65535, 65536, 65541, 98304, 133719, 163840, 300_000):
        assert deflated(raw[:n], 0) == n + 5 * (n // 32768 + 1) - 2, n
    for level in (1, 6, 9):
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        assert deflated(raw, level) == len(z.compress(raw) + z.flush()) - 2


def test_random_columns(spark):
    df = spark.range(40_000).select(F.lit(None).cast("string").alias("t")).select(fn.samplebyte("t").alias("b"), fn.uuid4("t").alias("u"))
    assert df.dtypes == [("b", "smallint"), ("u", "string")]
    r = df.agg(F.avg((F.col("b") == 1).cast("int")), F.avg((F.col("b") == 2).cast("int")), F.min("b"), F.max("b"), F.count_distinct("u"), F.min(F.length("u"))).first()
    assert abs(r[0] - 0.5) < 0.02 and abs(r[1] - 0.25) < 0.02 and r[2] == 1 and r[3] <= 64 and r[4] == 40_000 and r[5] == 32


def plain_scrub(text, patterns, to):
    hit = [0] * (len(text) + 1)
    touch = [False] * (len(text) + 1)
    for p in patterns:
        for m in re.finditer(p, text):
            hit[m.start() : m.end()] = [1] * (m.end() - m.start())
            touch[m.start()] = True
    out, i = "", 0
    while i < len(text):
        if hit[i]:
            out += to
            while i < len(text) and hit[i]:
                i += 1
        else:
            out += text[i]
            i += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab12 é", max_size=30))
def test_scrub_is_the_union_of_matches(text):
    patterns = ["ab", "b1", "[0-9]", "2 "]
    assert scrubbed(text, patterns, "<$1>") == plain_scrub(text, patterns, "<$1>")


def test_scrub_columns(spark):
    rows = [None, "", "abcd", "xabcdy", "123", "é1é", "ab ab"]
    want = [None, "", "R", "xRy", "R", "éRé", "R R"]
    p = ["ab", "bcd", "[0-9]"]
    assert column(spark, fn.scrub("text", patterns=p, replacement="R"), rows) == want
    assert column(spark, fn.scrub_native("text", patterns=p, replacement="R"), rows) == want
    assert column(spark, fn.scrub("text", patterns=[]), rows) == rows
    with pytest.raises(ValueError):
        fn.scrub("text", patterns=["("])


def test_native_scrub_equals_arrow_scrub(spark):
    rnd = random.Random(4)
    rows = ["".join(rnd.choice("ab1 .@é") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    p = ["[a-z]+@[a-z]+", "[0-9]", "b1", "\\."]
    assert column(spark, fn.scrub("text", patterns=p), rows) == column(spark, fn.scrub_native("text", patterns=p), rows)


def test_normalize_steps_in_order(spark):
    rows = [None, "", "A--B\n\nC\t  D", "café!", "ﬁ Ⅻ", "हिन्दी, ²x", "\n \n"]
    every = dict(contract_whitespace=True, remove_newlines=True, only_script=True, lowercase=True, form="NFC")
    assert column(spark, fn.normalize("text", **every), rows) == [None, "", "a b c d", "café ", "ﬁ ⅻ", "हिन्दी x", " "]
    assert column(spark, fn.normalize("text", form="NFKC"), rows)[4] == "fi XII"
    assert column(spark, fn.normalize("text", contract_whitespace=True), rows)[6] == "\n \n"
    assert column(spark, fn.normalize("text"), rows) == rows
    with pytest.raises(ValueError):
        fn.normalize("text", form="NFX")


def test_tokens_are_unicode_words(spark):
    assert column(spark, fn.tokens("text"), ["naïve हिन्दी foo_1 ²x", None, "-"]) == [["naïve", "हिन्दी", "foo_1", "x"], None, []]


def test_patterns():
    assert _regex.translate(r"[\s--\n]+").java == r"(?U)[\s&&[^\n]]+"
    assert _regex.translate("(?P<x>a)").java == "(?U)(?<x>a)"
    assert "a-zA-Z" in _regex.translate("[[:alpha:]]").java
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "a++", "[a", "(", "[[:nope:]]", "a\\"):
        with pytest.raises(ValueError):
            _regex.translate(bad)


def test_patterns_agree_between_engines(spark):
    rows = ["naïve 12_x", "a-b c\n\td", "ÀÉ½ ²", "हिन्दी", "tab x", string.printable]
    for p in (r"\w+", r"[[:alpha:]]+", r"[\s--\n]+", r"[\W&&\S]+", r"[^\w\s]", r"\d+", r"[a-c[x-z]]+"):
        assert column(spark, fn.tokens("text", pattern=p), rows) == [[m.group() for m in _regex.compiled(p).finditer(t)] for t in rows], p


def test_tokenize(spark, tmp_path):
    own = word_level()
    path = str(tmp_path / "t.json")
    own.save(path)
    rows = [None, "", "the of zebra.", "de la"]
    want = [None, [], [1, 2, 0, 31], [21, 22]]
    assert column(spark, fn.tokenize("text", tokenizer=own), rows) == want == column(spark, fn.tokenize("text", tokenizer=path), rows)
    with pytest.raises(ValueError):
        fn.tokenize("text", tokenizer=3)


def test_fasttext(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    write_model(path, {"good": (2.0, 0.0, 0.0), "bad": (0.0, 2.0, 0.0), EOS: (0.0, 0.0, 0.1)}, ["__label__a", "__label__b", "__label__c"])
    rows = [None, "", "good good", "bad\n\tbad bad", "unknown"]
    got = column(spark, fn.fasttext("text", path=path, labels=["__label__b", "__label__a"], output_scores=True), rows)
    assert all(v is None for v in got[0]) and [r.top_label for r in got[2:4]] == ["__label__a", "__label__b"]
    z = np.exp([4 / 3, 0, 0.1 / 3])
    assert got[2].top_score == pytest.approx(z[0] / z.sum() + 1e-5, rel=1e-5) and got[2]["__label__b"] == pytest.approx(z[1] / z.sum() + 1e-5, rel=1e-5)
    assert got[2].total_score == pytest.approx(got[2]["__label__a"] + got[2]["__label__b"], rel=1e-6)
    assert folded([], ["x", "y"]) == ("x", 0.0, 0, [0.0, 0.0])
    for bad in ({"labels": []}, {"labels": ["a", "a"]}, {"labels": ["a"], "output_aggregate": False}):
        with pytest.raises(ValueError):
            fn.fasttext("text", path=path, **bad)


def test_fasttext_format_variants(tmp_path):
    """Subwords, word n-grams, pruning, quantised matrices and other losses, on hand-made files."""

    def build(loss=3, bucket=0, minn=0, maxn=0, grams=1, quant=False, prune=()):
        words, labels = ["ab", EOS], ["x", "y"]
        rows = np.arange((2 + (len(prune) or bucket)) * 2, dtype="<f4").reshape(-1, 2) / 7
        out = [struct.pack("<ii", MAGIC, 12), struct.pack("<12i", 2, 5, 1, 1, 5, grams, loss, 3, bucket, minn, maxn, 100), struct.pack("<d", 0)]
        out.append(struct.pack("<iiiqq", 4, 2, 2, 1, len(prune) if prune else -1))
        out += [w.encode() + b"\0" + struct.pack("<qb", 5, 0) for w in words] + [w.encode() + b"\0" + struct.pack("<qb", c, 1) for w, c in zip(labels, (7, 3))]
        out += [struct.pack("<ii", a, b) for a, b in prune]
        if quant:
            m = len(rows)
            book = np.zeros(512, "<f4")
            book[: m * 2] = rows.ravel()
            out += [b"\1\0", struct.pack("<qqi", m, 2, m), bytes(range(m)), struct.pack("<iiii", 2, 1, 2, 2), book.tobytes()]
        else:
            out += [b"\0", struct.pack("<qq", *rows.shape), rows.tobytes()]
        out += [b"\0", struct.pack("<qq", 2, 2), np.eye(2, dtype="<f4").tobytes()]
        p = tmp_path / "v.bin"
        p.write_bytes(b"".join(out))
        return Model(str(p)), rows

    m, rows = build(bucket=50, minn=2, maxn=3)
    assert m.features("ab") == [0, *(2 + fnv(g.encode()) % 50 for g in ("<a", "<ab", "ab", "ab>", "b>")), 1]
    assert m.features("é", eos=False) == [2 + fnv(g.encode()) % 50 for g in ("<é", "<é>", "é>")]
    m, _ = build(bucket=50, grams=2)
    a, e = (x - 2**32 if x >= 2**31 else x for x in (fnv(b"ab"), fnv(EOS.encode())))
    assert m.features("ab") == [0, 1, 2 + ((a & (2**64 - 1)) * 116049371 + e) % 2**64 % 50]
    h = fnv(b"<a") % 50
    m, _ = build(bucket=50, minn=2, maxn=2, prune=((h, 0),))
    assert m.features("ab") == [0, 2, 1]
    m, rows = build(quant=True)
    assert np.allclose(m.input, rows)
    m, rows = build(loss=OVA)
    z = rows[:2].mean(0)
    assert dict(m.predict("ab")) == pytest.approx({k: 1 / (1 + math.exp(-v)) + 1e-5 for k, v in zip("xy", z)}, rel=1e-5)
    m, rows = build(loss=HS)
    assert sum(p for _, p in m.predict("ab")) == pytest.approx(1 + 2e-5)
    assert [len(p) for p in _tree([9, 4, 3, 2])] == [1, 2, 3, 3]


def test_batches_reach_functions_in_parts():
    most = []

    def sizes(text: pa.Array, other: pa.Array) -> pa.Array:
        most.append(sum(len(x or "") for x in text.to_pylist()))
        return pa.array([None if x is None else len(x) + y for x, y in zip(text.to_pylist(), other.to_pylist())], pa.int64())

    rows = ["x" * 1000] * 5000 + [None, "", "y" * 3_000_000, "z"]
    got = in_parts(sizes)(pa.array(rows), pa.array(range(len(rows)))).to_pylist()
    assert got == [None if x is None else len(x) + i for i, x in enumerate(rows)]
    assert max(n for n in most if n != 3_000_000) <= 1_000_001 and len(most) > 5
    lists = pa.array([["a"] * 50_000, None, [], ["b"] * 100_000, ["c"]] * 3)
    assert [i for i, _ in runs(lists)][0] == 0 and [j for _, j in runs(lists)][-1] == 15 and len(list(runs(lists))) > 5
    assert in_parts(sizes)(pa.array([], pa.string()), pa.array([], pa.int64())).to_pylist() == []


def test_namespace_and_sql(spark):
    namespace.register_namespace()
    df = texts(spark, [None, "A b A b A b"])
    got = df.select(F.col("text").textproc.normalize(lowercase=True).alias("n"), F.col("text").textproc.repetition_signals().alias("r"), F.col("text").textproc.minhash(buckets=2).alias("m"), F.col("text").textproc.uuid4().alias("u")).collect()
    assert got[1].n == "a b a b a b" and len(got[1].m) == 64 and got[0].m is None and len(got[0].u) == 32
    with pytest.raises(AttributeError):
        F.col("text").textproc.nothing  # noqa: B018
    names = namespace.register_sql(spark, "tp_")
    df.createOrReplaceTempView("some_texts")
    r = spark.sql("select tp_repetition_signals(text).top_1_gram_char_ratio x, tp_minhash(text) m, tp_compressed_size(text) c, tp_compression_ratio(text) q, tp_text_tokens(text) t, tp_uuid4() u, tp_samplebyte() b from some_texts order by id").collect()
    assert len(names) == 11 and r[0].x is None and r[1].x == 0.5 and r[1].c > 0 and r[1].q > 0 and r[1].t == list("AbAbAb") and len(r[0].u) == 32 and 1 <= r[0].b <= 64
    assert r[1].m == df.where("id = 1").select(fn.minhash("text").alias("m")).first().m


def test_relational_helpers(spark, tmp_path):
    df = sources.from_rows(spark, {"id": [1, 2], "text": ["a b", None]}, "id long, text string")
    out = operators.with_signals(df, n=F.octet_length("text"), m=fn.minhash("text"))
    assert out.columns == ["id", "text", "n", "m"] and operators.bucket_columns(out, "m", 2).columns[-2:] == ["bucket_0", "bucket_1"]
    (tmp_path / "f.txt").write_text("x")
    assert open(sources.shipped(sources.ship_file(spark, str(tmp_path / "f.txt")))).read() == "x"
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert sources.read_table(spark, str(tmp_path), "t", ["text"]).columns == ["text"]


def test_one_arrow_pass_for_all_signals(spark):
    df = operators.with_signals(texts(spark), a=fn.compressed_size("text"), b=fn.scrub("text", patterns=["x"]), c=fn.compression_ratio("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "PushedFilters" in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 5").select(fn.minhash("text"))._jdf.queryExecution().executedPlan().toString()


def test_streaming(spark, tmp_path):
    from corpusloom.streaming import stream_signals

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts(spark).repartition(3).write.parquet(src)
    q = stream_signals(spark, src, "id long, text string", out, str(tmp_path / "cp"), {"size": fn.compressed_size("text"), "m": fn.minhash("text")}, files_per_trigger=1)
    q.awaitTermination(60)
    got = {r.id: r.size for r in spark.read.parquet(out).collect()}
    assert got == {i: None if t is None else deflated(t.encode(), 6) for i, t in enumerate(EDGE)}
