import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa

from corpusloom.llm import _text as T
from corpusloom.llm import perplexity as P


def base(text):
    text = text or ""
    word = "[^\x20\x09-\x0d]+"
    w = re.findall(word, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(word, line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_base_counts_against_plain_python():
    rnd = random.Random(1)
    signs = ["a", "b", "é", "日", " ", "\n", "\t", "#", "<", "\r", "\x0b", "c d", "\x1f"]
    texts = ["", None, "\n", "\n\na\n\na", "a\n", " a", "x " * 30000] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    data, offsets = T.flat(pa.array(texts, pa.string()))
    got = list(zip(*(x.tolist() for x in P.base_counts(data, offsets))))
    assert got == [base(t) for t in texts]


def test_first_lines_of_later_texts_count():
    rnd = random.Random(4)
    texts = ["x y", "a\na", "", "c d\ne\nc d\n", "\n", "b\n\nb", None, "a\n", "a"] + ["".join(rnd.choice("ab\n \n") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    data, offsets = T.flat(pa.array(texts, pa.string()))
    got = list(zip(*(x.tolist() for x in P.base_counts(data, offsets))))
    assert got == [base(t) for t in texts]


def kneser_ney(texts):
    """A model of one language by definition: p(byte, context of ORDER - 1 bytes)."""
    top, texts_of = Counter(), defaultdict(set)
    for t in texts:
        raw = b" " * (P.ORDER - 1) + bytes(P._FOLD[b] for b in (t or "").encode())
        for i in range(P.ORDER - 1, len(raw)):
            top[raw[i - P.ORDER + 1 : i + 1]] += 1
            for k in range(1, P.ORDER + 1):
                texts_of[raw[i - k + 1 : i + 1]].add(t)
    c = {P.ORDER: top}
    for k in range(P.ORDER - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    vouched = lambda g: len(g) < 3 or len(texts_of[g]) > 1
    disc, total, mass = {}, {}, {}
    for k in c:
        m = [sum(v == j for v in c[k].values()) for j in (1, 2, 3, 4)]
        if min(m) > 0:
            y = m[0] / (m[0] + 2 * m[1])
            disc[k] = [max(0.1, min(j - 0.05, j - (j + 1) * y * m[j] / m[j - 1])) for j in (1, 2, 3)]
        else:
            disc[k] = [0.6, 1.2, 0.6 * 3]
        total[k], mass[k] = defaultdict(int), defaultdict(float)
        for g, x in c[k].items():
            total[k][g[:-1]] += x
            if vouched(g):
                mass[k][g[:-1]] += x - disc[k][min(x, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        ctx = g[:-1]
        if not total[k].get(ctx):
            return p(g[1:])
        gamma = max(1 - mass[k][ctx] / total[k][ctx], 1e-9)
        x = c[k].get(g, 0)
        own = (x - disc[k][min(x, 3) - 1]) / total[k][ctx] if x and vouched(g) else 0.0
        return own + gamma * p(g[1:])

    return p


def test_perplexity_against_the_definition(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "Thing", "ring", "of", "é"]) for _ in range(rnd.randint(1, 40))) for _ in range(60)] + ["qqq zzz", None, ""]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900, "other tongue other", None), (901, "other tongue", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc: r for r in P.signals(df, P.train(df)).collect()}
    p = kneser_ney(texts)
    for i, t in enumerate(texts):
        if not t:
            assert got[i].log_perplexity is None
            continue
        raw = b" " * (P.ORDER - 1) + bytes(P._FOLD[b] for b in t.encode())
        want = -np.mean([log(p(raw[k - P.ORDER + 1 : k + 1])) for k in range(P.ORDER - 1, len(raw))])
        assert abs(got[i].log_perplexity - want) < 1e-5 * want, (t, got[i].log_perplexity, want)
    assert got[900].log_perplexity > 0


def brute_bands(rows):
    """lang -> (median, a, b) from all (lang, n_bytes, log_perplexity), by definition."""
    out = {}
    at = lambda xs, q: (sorted(xs)[max(0, -int(-q * len(xs) // 1) - 1)] + 0.5) / P.STEPS
    for lang in {r[0] for r in rows}:
        own = [(n, int(v * P.STEPS // 1)) for x, n, v in rows if x == lang]
        classes = defaultdict(list)
        for n, v in own:
            classes[n.bit_length()].append((1 / n, v))
        points = []
        for rs in classes.values():
            y = max(at([v for _, v in rs], 0.75) - at([v for _, v in rs], 0.25), 1 / P.STEPS) ** 2
            x = sum(x for x, _ in rs) / len(rs)
            points.append((x, y, len(rs) / (x + 1 / P.LEVEL) ** 2))
        s, sx, sy, sxx, sxy = (sum(w * f for x, y, w in points for f in [g(x, y)]) for g in (lambda x, y: 1, lambda x, y: x, lambda x, y: y, lambda x, y: x * x, lambda x, y: x * y))
        det = s * sxx - sx * sx
        b = max(0.0, (s * sxy - sx * sy) / det) if det > 1e-9 * s * sxx else 0.0
        a = (sy - b * sx) / s
        out[lang] = (at([v for _, v in own], 0.5), max(a, 0.0), sxy / sxx if a < 0 else b)
    return out


def test_bands_and_verdicts_against_the_definition(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        n = int(2 ** rnd.uniform(5, 13))
        lang = rnd.choice(["en", None, "fr"])
        value = 1.5 + (lang == "fr") * 0.4 + rnd.gauss(0, (0.015**2 + 0.8 / n) ** 0.5) + rnd.choice([0] * 30 + [-0.4, 0.5])
        rows.append((i, lang, n, rnd.choice([5, 50, 50, 50]), 0, 0, 0, rnd.choice([0, 0, 0, 30]), value))
    rows += [(1000 + i, "de", 100, 50, 0, 0, 0, 0, 1.2 + i / 100) for i in range(5)] + [(2000, "en", 0, 0, 0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "doc long, lang string, n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double")
    want = brute_bands([(r[1], r[2], r[8]) for r in rows if r[8] is not None])
    got = {r.doc: r for r in P.judged(df).collect()}
    assert len(got) == len(rows)
    kept = 0
    for r in rows:
        mid, a, b = want[r[1]]
        dev = (a + b / max(r[2], 1)) ** 0.5 / P.QUARTILES
        low, high = mid - P.LOW * dev, mid + P.HIGH * dev
        g = got[r[0]]
        assert abs(g.lower - low) < 1e-6 and abs(g.upper - high) < 1e-6
        failed = r[3] < 10 or 100 * r[7] > 20 * r[3]
        assert g.base_failed == failed and g.kept == (not failed and r[8] is not None and low <= r[8] <= high)
        kept += g.kept
    assert 0 < kept < len(rows)


def test_texts_of_few_strings_and_random_texts_are_rejected(spark):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(2000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(30, 400))), "en") for i in range(400)]
    few = sorted(words, key=len)[-25:]
    rows += [(1000, " ".join(rnd.choice(few) for _ in range(300)), "en"), (1001, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc: r for r in P.judged(P.signals(df, P.train(df))).collect()}
    assert not got[1000].base_failed and got[1000].log_perplexity < got[1000].lower and not got[1000].kept
    assert not got[1001].base_failed and got[1001].log_perplexity > got[1001].upper and not got[1001].kept
    assert sum(got[i].kept for i in range(400)) >= 392


def test_judgement_and_edges(spark):
    rnd = random.Random(3)
    words = ["stone", "river", "light", "under", "their", "walking", "seven", "paper", "cold", "bring", "often", "yellow"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)), "en") for i in range(150)]
    rows += [(500, None, "en"), (501, "", None), (502, "few words", "en"), (503, "a b c d e f g h i j k " * 9, "en"), (504, " ".join("".join(rnd.choice("qxzjkvw#0123456789~^") for _ in range(7)) for _ in range(60)), "en"), (None, rows[0][1], "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, log_perplexity double")
    got = {r.doc: r for r in P.judged(P.signals(df, P.train(df))).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].kept for i in range(150)) >= 145 and not any(got[i].base_failed for i in range(150)) and got[None].kept == got[0].kept
    assert all(got[i].base_failed and not got[i].kept for i in (500, 501, 502, 503))
    assert not got[504].base_failed and not got[504].kept
    empty = df.limit(0)
    assert P.judged(P.signals(empty, P.train(empty))).count() == 0
