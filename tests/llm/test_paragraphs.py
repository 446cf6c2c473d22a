import os
import random
import re

import numpy as np

from corpusloom.llm import _links
from corpusloom.llm import paragraphs as P
from corpusloom.llm._links import settled
from corpusloom.llm._spark import shared_dir
from tests.llm.test_forest import prose

ORDER = {}


def number(word):
    return sum(b * ((i % 64 + 1) ** 2 * 7919 + (i % 64 + 1) * 104729) for i, b in enumerate(word.encode())) % (2**31 - 1)


def places(w):
    """Anchors of one text's words, by trying every stretch of places."""
    n = len(w) - P.WORDS + 1
    if n < 1:
        return []
    h = [number(x) for x in w]
    value = [((h[p] * 48271 + h[p + 1] * 69621) % (2**31 - 1), p) for p in range(n)]
    return sorted({min(value[k : k + P.EVERY])[1] for k in range(max(1, n - P.EVERY + 1))})


def spans(parts):
    out = []
    for a, n in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(a + n, out[-1][1])
        else:
            out.append([a, a + n])
    return [tuple(x) for x in out]


def units_of(text):
    """(first word, words, content) of a text's paragraphs: word lists for those by content, shingle sets for those between newlines."""
    lines = [re.findall("[^\x20\x09-\x0d]+", x.translate({i: i + 32 for i in range(65, 91)})) for x in (text or "").split("\n")]
    w = [x for line in lines for x in line]
    out, at = [(p, P.WORDS, tuple(w[p : p + P.WORDS])) for p in places(w)], 0
    for line in lines:
        if len(line) >= P.WORDS:
            out.append((at, len(line), frozenset(zip(line, line[1:], line[2:]))))
        at += len(line)
    return out


def brute(rows):
    units = [((P.LAST if d is None else d, p, ORDER.get(t, 0), n), x) for d, t in set(rows) for p, n, x in units_of(t)]
    kinds = list({x for _, x in units})
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [x for x in kinds if isinstance(x, frozenset)]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            n = len(a & b)
            if 100 * n >= 75 * (len(a) + len(b) - n):
                root[find(a)] = find(b)
    groups = {}
    for key, x in units:
        groups.setdefault(find(x), []).append(key)
    texts = {}
    for g in groups.values():
        d, p, h, m = min(g)
        gone = [k for k in g if (k[0], k[2]) != (d, h) or k[1] >= p + m or p >= k[1] + k[3]]
        for k in g if gone else []:
            texts.setdefault((k[0], k[2]), []).append((k[1], k[3], (d, p, h, m), k in gone, len(gone) + 1))
    out = []
    for (d, _), parts in texts.items():
        for a, b in spans([x[:2] for x in parts]):
            inside = sorted(x for x in parts if a <= x[0] < b)
            cut = spans([x[:2] for x in inside if x[3]])
            out.append((d, a, b - a, sum(y - x for x, y in cut), *inside[0][2][:2], inside[0][4], tuple(cut)))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int")
    ORDER.update({r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()})
    found = P.duplicate_passages(df).collect()
    return sorted((r.doc, r.first_word, r.n_words, r.n_removed, r.class_doc, r.class_word, r.copies, tuple((x.a, x.b) for x in r.removed)) for r in found)


def test_edges(spark):
    long = " ".join("w%d" % i for i in range(P.WORDS))
    rows = [(1, None), (2, ""), (3, long + "\n" + long.upper()), (4, "\n\n" + long), (5, " ".join(long.split()[1:])), (None, long), (6, long + "\r\n" + "x " * 900), (7, "x " * 700), (7, "x " * 700), (8, "y" * 70000)]
    assert run(spark, rows) == brute(rows)
    one, two = " ".join(prose(random.Random(1), 60)), " ".join(prose(random.Random(2), 60))
    rows = [(None, one), (None, two), (None, one + "\n" + two), (4, one), (4, two), (4, one + " "), (4, one)]
    got = run(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {4, P.LAST}
    assert run(spark, []) == []


def test_passages_inside_longer_paragraphs_are_found_and_short_boilerplate_is_not(spark):
    rnd = random.Random(23)
    passage, line = prose(rnd, P.WORDS + P.EVERY - 1), prose(rnd, 14)
    rows = [(i, " ".join(prose(rnd, rnd.randrange(120)) + (passage if i % 2 else line) + prose(rnd, rnd.randrange(120)))) for i in range(40)]
    got = run(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == set(range(1, 40, 2))
    assert [r[0] for r in got if not r[3]] == [1]


def test_against_brute_force(spark):
    rnd = random.Random(21)
    pool = [prose(rnd, rnd.choice([30, 50, 90])) for _ in range(30)]
    rows = []
    for i in range(90):
        text = []
        for _ in range(rnd.randint(0, 4)):
            w = list(rnd.choice(pool)) if rnd.random() < 0.5 else prose(rnd, rnd.choice([5, 12, 40]))
            for _ in range(rnd.choice([0, 0, 1, 3])):
                w[rnd.randrange(len(w))] = "e%d" % rnd.randrange(10**6)
            text.append(" ".join(w))
        rows.append((i, rnd.choice("\n ").join(text)))
    assert run(spark, rows) == brute(rows)


def test_removals_leave_first_copies_and_all_else(spark):
    rnd = random.Random(24)
    passage, a, b = (" ".join(prose(rnd, n)) for n in (80, 30, 30))
    rows = [(1, a + " " + passage), (2, passage + "\n" + b), (None, None), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: r.text for r in P.without_repeats(df).collect()}
    ends = [p for p in places(passage.split())]
    gone = passage.split()[: ends[0]] + passage.split()[ends[-1] + P.WORDS :]
    assert got[1] == rows[0][1] and got[None] is None and got[3] == "short"
    assert set(b.split()) <= set(got[2].split()) and len(got[2].split()) <= 30 + len(gone)


def near(rnd, n):
    """Texts of one line each: ``n`` pairs of near copies."""
    out = []
    for _ in range(n):
        w = prose(rnd, 60)
        out += [(len(out), " ".join(w)), (len(out) + 1, " ".join([*w[:-1], "other"]))]
    return out


def test_sets_are_deleted_once_links_are_known(spark):
    rows = near(random.Random(25), 6)
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert run(spark, rows) == brute(rows)
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert "repeats" in left and not left & {"bodies", "paragraphs"}


def test_only_sets_of_pairs_at_hand_are_moved(spark, monkeypatch):
    """Some sets have no pair: few identities are told to all tasks, many are not, and the links are the same."""
    seen = []
    kept = _links._needed
    monkeypatch.setattr(_links, "_needed", lambda *a: seen.append(kept(*a)) or seen[-1])
    bodies = spark.createDataFrame([(i, np.arange(i // 2, i // 2 + 40, dtype=np.uint64).tobytes()) for i in range(40)], "rid long, body binary")
    pairs = spark.createDataFrame([(0, 1, 3), (2, 3, 3), (0, 30, 1)], "a long, b long, same int")
    for ids, moved in ((_links.BROADCAST_IDS, [{0, 2}, {1, 3, 30}]), (2, [set(range(40))] * 2)):
        seen.clear()
        monkeypatch.setattr(_links, "BROADCAST_IDS", ids)
        assert {tuple(r) for r in _links.linked(pairs, bodies, P.reaches).collect()} == {(0, 1), (2, 3)}
        assert [{r.rid for r in x.select(x.columns[0]).collect()} for x in seen] == moved


def test_linked_pairs_far_apart_in_a_crowded_key(spark, monkeypatch):
    """80 linked pairs among sets of one key that else stay below the threshold."""
    rnd = random.Random(22)
    common = [rnd.randrange(2, 2**63) for _ in range(80)]
    sets = [sorted(common + [rnd.randrange(2, 2**63) for _ in range(20)]) for _ in range(80)]
    sets += [sorted(sorted(x, key=lambda v: v not in common)[:90] + [rnd.randrange(2, 2**63) for _ in range(10)]) for x in sets]
    bodies = spark.createDataFrame([(i, np.array(x, np.uint64).tobytes()) for i, x in enumerate(sets)], "rid long, body binary")
    monkeypatch.setattr(P, "WINDOW", 2)
    keys = spark.createDataFrame([((5 << P.MORE_BITS) + i % 3, i) for i in range(160)], "s long, rid long")
    shape = {"prefix": 6, "s_bytes": 8, "sketch_bytes": 0, "least_same": 0, "window": 2, "ratio": 0.75}
    links, comp = settled(P.colliding(keys), lambda wanted: bodies, P.reaches, shape, P.LATE)
    assert {tuple(r) for r in links.select("a", "b").collect()} == {(i, i + 80) for i in range(80)}
    assert comp.count() == 160


def test_rows_in_many_ranges_meet_across_their_edges(spark, monkeypatch):
    monkeypatch.setattr(_links, "EDGE_ROWS", 40)
    monkeypatch.setattr(P, "WINDOW", 3)
    keys = spark.createDataFrame([((k // 5 << P.MORE_BITS) + k % 5, k) for k in range(400)], "s long, rid long").repartition(8)
    pairs, dense = P.colliding(keys)
    assert {tuple(r) for r in pairs.select("a", "b").collect()} >= {(a, b) for b in range(400) for a in range(max(0, b - 3), b) if a // 5 == b // 5}
    assert dense.count() == 400
