import random
import re

import numpy as np
import pyarrow as pa

from corpusloom.llm import _links, _text, forest


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n int, rid string")
    return sorted(((r.doc, r.n_shingles, r.component) for r in forest.near_duplicates(df).collect()), key=str)


def prose(rnd, n):
    return [rnd.choice("abcdefghijklmnopqrst") + rnd.choice("xyz") + str(rnd.randrange(30)) for _ in range(n)]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b"), (6, "b a"), (None, "a  b"), (7, " \n\t"), (8, "A\nB"), (None, "zz"), (None, "zz"), (9, "w " * 50000), (9, "w w"), (9, "other text here")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_against_brute_force(spark):
    rnd = random.Random(11)
    rows, i = [], 0
    for g in range(60):
        base = prose(rnd, rnd.choice([8, 20, 60, 200]))
        for _ in range(rnd.choice([1, 1, 2, 3, 6])):
            w = list(base)
            for _ in range(int(len(w) * rnd.choice([0, 0.01, 0.04, 0.08, 0.1, 0.3]))):
                w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(10**6)
            rows.append((i, " ".join(w)))
            i += 1
    assert run(spark, rows) == brute(rows)


def test_crowded_group_beyond_the_window(spark, monkeypatch):
    monkeypatch.setattr(_links, "AT_ONCE", 100)
    rnd = random.Random(12)
    rows = []
    for g in range(2):
        base = prose(rnd, 120)
        for k in range(90):
            w = list(base)
            w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_star_components_match_one_task(spark):
    rnd = random.Random(13)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in _links.components(df).select("id", "comp").collect()}
    assert one == {tuple(r) for r in _links.star_components(df).select("id", "comp").collect()}


def test_hashes_fold_and_split_as_words():
    data, offsets = _text.flat(pa.array(["Ab c", None, "aB  C\x0b", "x"]))
    s, e, w = _text.word_bounds(data, offsets)
    h = _text.span_hashes(data, s, e)
    assert w.tolist() == [0, 2, 2, 4, 5] and (h[:2] == h[2:4]).all() and len(np.unique(h)) == 3


def test_rows_that_link_to_one_member_of_a_crowded_family(spark):
    rnd = random.Random(14)
    base = prose(rnd, 120)
    rows = []
    for k in range(80):
        w = list(base)
        w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(10**6)
        rows.append((len(rows), " ".join(w)))
    for k in range(4):
        member = base + prose(rnd, 30)
        rows.append((len(rows), " ".join(member)))
        for _ in range(2):
            w = list(member)
            for at in rnd.sample(range(110), 8):
                w[at] = "edit%d" % rnd.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    want = brute(rows)
    assert len({c for _, _, c in want}) < 6 and run(spark, rows) == want


def far_apart(spark, rnd, pairs):
    """Orders of one run in which the two of each linked pair stand far apart, their bodies, and the links."""
    common = [rnd.randrange(1, 2**63) for _ in range(160)]
    sets = [sorted(common + [rnd.randrange(1, 2**63) for _ in range(36)]) for _ in range(pairs)]
    sets += [sorted(x[:-20] + [rnd.randrange(1, 2**63) for _ in range(20)]) for x in sets]
    flat, cut = np.concatenate([np.array(x, np.uint64) for x in sets]), np.arange(len(sets) + 1) * 196
    sig = forest.minhashes(flat, cut, forest._MULTIPLY, forest._ADD).reshape(-1, forest.TREES, forest.DEPTH)[:, :, :2]
    sketch = (sig >> np.uint64(32)).astype(np.uint8).reshape(len(sets), -1)
    orders = [(0, b"prefix" + bytes([i // 256, i % 256]), i, 196, bytes(sketch[i])) for i in range(len(sets))]
    bodies = spark.createDataFrame([(i, np.array(x, np.uint64).tobytes()) for i, x in enumerate(sets)], "rid long, body binary")
    near = lambda x, y: 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))
    return orders, bodies, {(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])}


def test_linked_pairs_far_apart_in_a_crowded_run_of_no_main_component(spark):
    orders, bodies, want = far_apart(spark, random.Random(15), 40)
    shape = {"prefix": 6, "s_bytes": 8, "sketch_bytes": 48, "least_same": forest.LEAST_SAME, "window": 3, "ratio": 0.75}
    links, comp = _links.settled(_links.candidates(spark.createDataFrame(orders, _links.ORDER_ROW), **shape), lambda wanted: bodies, forest.reaches, shape)
    assert {tuple(r) for r in links.select("a", "b").collect()} == want == {(i, i + 40) for i in range(40)}
    assert comp.count() == 80
