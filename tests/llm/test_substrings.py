import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import substrings as S
from corpusloom.llm.suffixes import suffix_array


def test_suffix_arrays_against_sorting():
    rnd = random.Random(1)
    for _ in range(2000):
        t = [rnd.randint(1, rnd.randint(1, 4)) for _ in range(rnd.randint(0, 40))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    for t in ([1] * 500, [1, 2] * 300, [2, 1] * 300, list(range(1, 300)), list(range(300, 0, -1))):
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + S.LENGTH] for r in raws for i in range(len(r) - S.LENGTH + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - S.LENGTH + 1):
            if seen[r[i : i + S.LENGTH]] > 1:
                gone[i] += 1
                gone[min(i + S.LENGTH, len(r))] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(r, np.uint8)[~mask])
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((d, len(r), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, tkey int")
    return sorted((tuple(r) for r in S.deduplicated(df, content=False).collect()), key=str)


def corpus(seed, n=40):
    rnd = random.Random(seed)
    chars = "abcdefghijklmnop é日 \n"
    some = lambda k: "".join(rnd.choice(chars) for _ in range(k))
    pool = [some(rnd.randint(150, 700)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(rnd.randint(0, 4)):
            x = rnd.choice(pool) if rnd.random() < 0.6 else some(rnd.randint(1, 300))
            if rnd.random() < 0.5:
                a = rnd.randrange(len(x))
                x = x[a : a + rnd.randint(100, 500)]
            if rnd.random() < 0.4 and len(x) > 2:
                k = rnd.randrange(len(x))
                x = x[:k] + "Z" + x[k + 1 :]
            t.append(x)
        rows.append((i, "".join(t)))
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, "a" * 199), (903, "a" * 200), (904, "a" * 201), (905, "ab" * 400), (906, "q" + "ab" * 150), (None, "xyz" * 100), (None, "xyz" * 100), (907, "k" * 60000)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_more_seeds(spark, seed):
    rows = corpus(seed, 60)
    assert run(spark, rows) == brute(rows)


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 3)
    rows = corpus(4)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
