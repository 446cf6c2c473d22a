import random
import re

from corpusloom.llm import licences as L


def test_matching_statistics_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        seqs = [[rnd.randrange(3) for _ in range(rnd.randint(1, 12))] for _ in range(4)]
        auto = L.Automaton(seqs)
        text = [rnd.randrange(4) for _ in range(40)]
        lengths, states = auto.stream(text)
        for i, n in enumerate(lengths):
            want = max((k for k in range(i + 2) if any(s[a : a + k] == text[i + 1 - k : i + 1] for s in seqs for a in range(len(s) - k + 1))), default=0)
            assert n == want
            if n:
                places = {(no, a + n - 1) for no, s in enumerate(seqs) for a in range(len(s) - n + 1) if s[a : a + n] == text[i + 1 - n : i + 1]}
                assert places == set(auto.places[states[i]])


def brute(text):
    low = (text or "").translate(L._LOWER)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_and_labels(spark):
    rnd = random.Random(5)
    parts = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "under the", "mit", "é ñ", "word", "License", "\n", "GNU General Public License, version 3"]
    texts = [None, "", "Released under the MIT License.", "x " * 50000 + "cc by nc", *(" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(200))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in L.scan_licences(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[0].labels == "" and got[0].score == 0
    assert L.scan_licences(df.limit(0)).count() == 0


def every_chain(runs, last=None):
    """Most words over all orders of all subsets of runs, each cut at its start by what the one before has passed."""
    best = 0
    for k, (a, t, n) in enumerate(runs):
        cut = max(0, last[0] - a, last[1] - t) if last else 0
        if cut < n and (not last or a + cut - last[0] <= L.MAX_GAP):
            best = max(best, n - cut + every_chain(runs[:k] + runs[k + 1 :], (a + n, t + n)))
    return best


def test_chains_against_all_orders_of_all_subsets():
    assert L.best_chain([(0, 1, 7), (8, 7, 3), (11, 10, 4)])[0] == 13
    rnd = random.Random(6)
    for _ in range(2000):
        runs = [(rnd.randrange(rnd.choice([30, 200])), rnd.randrange(30), rnd.randint(3, 9)) for _ in range(rnd.randint(1, 7))]
        covered, chain = L.best_chain(runs)
        assert covered == every_chain(runs) == sum(n for _, _, n in chain), runs
        for (a, t, n), (b, u, _) in zip(chain, chain[1:]):
            assert a + n <= b <= a + n + L.MAX_GAP and t + n <= u


def common_runs(text, template):
    out = []
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and (not i or not j or text[i - 1] != template[j - 1]):
                n = 0
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= L.MIN_MATCH:
                    out.append((i, j, n))
    return out


def test_runs_against_all_pairs_of_words():
    rnd = random.Random(7)
    words = "a b c d e".split()
    for _ in range(40):
        templates = tuple(("x", (), " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 14)))) for _ in range(4))
        scan = L.Scanner(templates, {}, L.MIN_MATCH)
        text = [rnd.choice(words) for _ in range(60)]
        number = {w: i for i, w in enumerate(sorted({w for _, _, t in templates for w in t.split()}))}
        got = scan.runs([number.get(w, -1) for w in text])
        for no, (_, _, t) in enumerate(templates):
            assert sorted(got.get(no, [])) == sorted(common_runs(text, t.split()))


def brute_labels(text):
    """Labels and score by trying every template on whole texts, word pair by word pair."""
    words = L.words_of(text or "")
    labels = {x for p, x in L.BASE.items() if f" {p} " in f" {' '.join(words)} "}
    score, found = float(bool(labels)), []
    for no, (label, parts, t) in enumerate(L.TEMPLATES):
        t = L.words_of(t)
        runs = common_runs(words, t)
        if runs:
            covered, chain = L.best_chain(runs)
            score = max(score, covered / len(t))
            tells = all(any(" ".join(L.words_of(p)) in " ".join(t[u : u + n]) for _, u, n in chain) for p in parts)
            if tells and (covered == len(t) if len(t) <= L.WHOLE else covered >= L.MIN_COVER * len(t)):
                found.append((-covered, -covered / len(t), no, label, chain[0][0], chain[-1][0] + chain[-1][2]))
    kept = []
    for f in sorted(found):
        if all(2 * (min(f[5], k[5]) - max(f[4], k[4])) < f[5] - f[4] for k in kept):
            kept.append(f)
    return ",".join(sorted(labels | {f[3] for f in kept})), min(1.0, score)


def test_labels_and_scores_against_brute_force(spark):
    rnd = random.Random(8)
    texts = [None, "", "Released under the MIT License."]
    for _ in range(120):
        w = L.words_of(rnd.choice(L.TEMPLATES)[2])
        for _ in range(rnd.choice([0, 0, 1, 4])):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 2)] = [rnd.choice(["of", "the", "new", "word"]) for _ in range(rnd.randint(0, 2))]
        texts.append(" ".join(["some", "words"] * rnd.randint(0, 9) + w + ["end"] * rnd.randint(0, 5)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licences(df).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_labels(t)
        assert (got[i].labels, round(got[i].score, 9)) == (labels, round(score, 9)), t


def test_false_friends_give_no_label(spark):
    gpl_2 = next(t for label, _, t in L.TEMPLATES if label == "gpl-2")
    rows = [
        ("SPDX-License-Identifier: ISC", "isc"),
        ("Released under the GPL license", ""),
        ("this press release was released under the embargo rules", ""),
        ("it is under the terms of the contract. The general public license fee", ""),
        (gpl_2, "gpl-2"),
        ("// SPDX-License-Identifier: MIT", "mit"),
    ]
    rows += [(t, label) for label, _, t in L.TEMPLATES]
    got = {r.doc_id: r for r in L.scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    for i, (t, label) in enumerate(rows):
        assert got[i].labels == label, t
        assert [s.label for s in got[i].spans] == [label] * bool(label)


def test_edited_template_is_found_and_prose_is_not(spark):
    mit = "Permission is hereby granted, free of cost, to any person obtaining a copy of this program and associated documentation files"
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "intro words " + mit), (2, gpl), (3, "the work is good and the public version is under review"), (3, "the work is good and the public version is under review")]
    got = L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r.labels for r in got}
    assert by[1] == "mit" and by[2] == "gpl-3" and by[3] == "" and len(got) == 4
