import random
import zlib

import numpy as np
import pyarrow as pa

from corpusloom.llm import toxicity as X


def sets(texts):
    got = list(X.term_sets(pa.array(texts, pa.string())))
    assert len(got) == 1
    return got[0]


def test_pairs_are_learned_that_additive_weights_miss():
    """Labels that no term tells anything of alone."""
    rnd = random.Random(2)
    texts, y = [], []
    for _ in range(3000):
        w = [rnd.choice("abcdefgh") + str(rnd.randrange(20)) for _ in range(12)]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        w += ["insult"] * a + ["group"] * b
        texts.append(" ".join(w))
        y.append(int(a == b))
    m = X.fit(*sets(texts[:1500]), np.array(y[:1500], float))
    right = ((m.score(*sets(texts[1500:])) >= 0.5) == np.array(y[1500:])).mean()
    assert right > 0.95
    assert {m.slots[sets([x])[0][0]] >= 0 for x in ("insult", "group")} == {True}
    m.factors = m.factors * 0
    assert ((m.score(*sets(texts[1500:])) >= 0.5) == np.array(y[1500:])).mean() < 0.7


def test_scores_against_plain_sums():
    rng = np.random.default_rng(0)
    slots = np.full(X.BUCKETS, -1, np.int32)
    texts = ["a b c a", None, "", "c d", "zz " * 1000 + "a"]
    for k, word in enumerate("abcd"):
        slots[sets([word])[0][0]] = k
    m = X.Machine(0.3, slots, rng.normal(size=4), rng.normal(size=(4, X.FACTORS)))
    got = m.raw(*sets(texts))
    for t, g in zip(texts, got):
        f = sorted({"abcd".index(w) for w in (t or "").split() if w in "abcd"})
        want = 0.3 + sum(m.weights[i] for i in f) + sum(m.factors[i] @ m.factors[j] for i in f for j in f if i < j)
        assert abs(want - g) < 1e-9


def data(n=600, seed=4):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice("klmnop") + str(rnd.randrange(40)) for _ in range(rnd.randint(5, 60))]
        bad = rnd.random() < 0.3
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["nasty", "vile"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_nulls_and_repeats(spark):
    docs, labels = data()
    docs += [(None, None), (9001, ""), (9002, None), (0, docs[0][1]), (9003, "x " * 50000 + "vile")]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = X.train(d, lab)
    got = X.score(d.drop("score"), m).select("doc_id", X.held_out("doc_id").alias("h"), "_toxicity.score", "_toxicity.predicted").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.h and r.doc_id in truth]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {}
    for r in got:
        by.setdefault(dict(docs).get(r.doc_id) or "", set()).add(round(r.score, 12))
    assert len(by[""]) == 1
    again = X.train(d.repartition(3), lab)
    assert again.bias == m.bias and np.array_equal(again.weights, m.weights)


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    m = X.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert X.score(d, m).select("_toxicity.score").first().score == 0.5
    assert X.score(d.limit(0), m).count() == 0
