import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import decontaminate as D
from tests.llm.test_forest import prose


def plain(x, y):
    """Smith-Waterman by the textbook."""
    h = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if x[i - 1] == y[j - 1] else D.MISS), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_alignment_against_textbook():
    rnd = np.random.default_rng(1)
    xs = [rnd.integers(1, 5, rnd.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    ys = [rnd.integers(1, 5, rnd.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    assert D.align(xs, ys)[0].tolist() == [plain(x, y) for x, y in zip(xs, ys)]


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    b = spark.createDataFrame(items, "item_id long, text string")
    return D.contaminated(d, b).collect()


def test_planted_copies_and_clean_documents(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(prose(rnd, 40))) for i in range(12)]
    docs, want = [], set()
    for i in range(120):
        w = prose(rnd, 300)
        if i % 3 == 0:
            k = rnd.randrange(12)
            leak = items[k][1].split()
            for _ in range(rnd.choice([0, 2, 5])):
                leak[rnd.randrange(40)] = "changed"
            if rnd.random() < 0.5:
                leak[10:10] = ["put", "in"]
                del leak[30]
            at = rnd.randrange(300)
            w[at:at] = leak
            want.add((i, k, at))
        docs.append((i, ", ".join(w).title()))
    got = run(spark, docs, items)
    assert {(r.doc, r.item) for r in got} == {x[:2] for x in want}
    spans = {(r.doc, r.item): r for r in got}
    for d, k, at in want:
        r = spans[d, k]
        assert abs(r.first_word - at) <= 3 and 30 <= r.last_word - r.first_word + 1 <= 46 and 0.5 <= r.score <= 1


def test_edges(spark):
    item = "the quick brown fox jumps over lazy dogs tonight"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "x " * 60000 + item), (4, "the quick brown dogs")]
    got = sorted(((r.doc, r.item, r.score) for r in run(spark, docs, [(7, item), (8, None), (9, ""), (10, "the quick"), (None, item)])), key=str)
    assert got == sorted([(d, i, 1.0) for d in (3, 3, None) for i in (7, 10, None)] + [(4, 10, 1.0)], key=str)
    assert run(spark, [], [(7, item)]) == [] and run(spark, docs, []) == []


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    items = [(i, " ".join(prose(rnd, 30))) for i in range(20)]
    docs = [(i, " ".join(prose(rnd, 50)) + " " + items[i % 20][1]) for i in range(40)]
    whole = sorted(tuple(r) for r in run(spark, docs, items))
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    assert sorted(tuple(r) for r in run(spark, docs, items)) == whole and len(whole) == 40


def test_edited_and_recased_copies_against_brute_force_alignment(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(w + rnd.choice(["", "ß", "ñó"]) for w in prose(rnd, n))) for i, n in enumerate([5, 6, 7, 9, 15, 24, 30, 41])]
    docs, capitals = [], set()
    for k, text in items:
        own = text.split()
        spaced = [x for w in own for x in (w, "between")]
        copies = [[("new" if i % step == start else w) for i, w in enumerate(own)] for step in (2, 3, 4) for start in range(step)]
        capitals.add((len(docs), k))
        for copy in [text.upper().split(), spaced[:-1], spaced[1:-2], own[: len(own) // 2 + 1], own[::2], own[::-1], *copies]:
            w = prose(rnd, 40) + copy + prose(rnd, 40)
            #: Pairs of every item all over the corpus, rarer than those that survive.
            docs.append((len(docs), " ".join(w + own[:2] + prose(rnd, 3) + own[-2:])))
    fold = lambda t: t.casefold().split()
    want = {(d, k): v for d, t in docs for k, i in items if (v := plain(fold(i), fold(t))) >= D.LEAST_SCORE * D.MATCH * len(i.split())}
    got = {(r.doc, r.item): round(r.score * D.MATCH * len(items[r.item][1].split())) for r in run(spark, docs, items)}
    assert got == want and capitals <= set(got) and len(want) > 70


def test_short_items_stand_whole_and_unspaced_scripts_have_words(spark):
    japanese = "日本語の文章は空白で区切られない"
    items = [(1, "One"), (2, "two words"), (3, "now three words"), (4, "this is four words"), (5, japanese), (5, japanese), (6, "two words")]
    docs = [(1, "ONE two, words"), (2, "two other words"), (3, "this is four words; this is four words"), (4, "前置き" + japanese[:6] + japanese[7:] + "後書き"), (5, "日本と文章"), (6, "then now three-words")]
    got = sorted((r.doc, r.item, r.item_words, r.seeds, r.first_word, r.last_word) for r in run(spark, docs, items) if r.doc != 4)
    assert got == [(1, 1, 1, 1, 0, 0), (1, 2, 2, 1, 1, 2), (1, 6, 2, 1, 1, 2), (3, 4, 4, 2, 0, 3), (6, 3, 3, 1, 1, 3)]
    far = [r for r in run(spark, docs, items) if r.doc == 4]
    assert [(r.item, r.item_words) for r in far] == [(5, 16)] * 2 and all(r.score > 0.8 for r in far)


def test_the_query_finds_all_pairs_that_align(spark):
    """All documents of the smallest table against all items, by alignment alone."""
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))

    def words(t):
        data, offsets = D.T.flat(D.folded(pa.array([t], pa.string())))
        s, e, _ = D.T.word_bounds(data, offsets, D.T.ALNUM)
        return D.T.span_hashes(data, s, e)

    held = [(i, words(t)) for i, t in items]
    want = {}
    for d, t in docs:
        whole = words(t)
        for (i, x), best in zip(held, D.align([x for _, x in held], [whole] * len(held))[0].tolist() if len(whole) else []):
            if best >= D.LEAST_SCORE * D.MATCH * len(x) >= D.LEAST_WORDS:
                want[d, i] = round(best / (D.MATCH * len(x)), 9)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in D.op1_benchmark_alignment(spark, sf).collect()}
    assert got == want and want
