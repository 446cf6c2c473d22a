"""Licence scans with a generalised suffix automaton over the tokens of licence templates.

The automaton holds every template (``licence_texts``: whole licences, notices, identification lines). A text
streams through it once and yields matching statistics: for each word, the longest match ending there and, by
suffix links, all shorter ones, so that every run of at least ``MIN_MATCH`` words common to text and template is
known. Per template the runs are chained, in order in both with at most ``MAX_GAP`` words of text between two, into
the most template words that can be covered so; runs that overlap a chain's end count for what is left of them.
A template is found where its chain covers ``MIN_COVER`` of its words (of ``WHOLE`` words or fewer, all) and holds each
of the parts that tell it from its likes in one run. Of templates found in one place, that which covers most words
gives its label. Only places where ``MIN_MATCH`` consecutive words occur in a template can hold a run, so
vectorised hashes find them and the rest is skipped.

Words are runs of ASCII letters and digits, lower-cased, and of anything beyond ASCII.
Defined results: null and empty texts have no words, empty labels, null places and score 0; texts are
scanned whole; rows are independent, so repeated rows repeat; of templates that cover equally many words in one
place the larger share and then the first in order counts; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._spark import small_batches, table
from .licence_texts import TEMPLATES

#: Shortest run, in words, that counts towards a template.
MIN_MATCH = 3
#: Least covered share of a template's words for its label; templates of so few words must be covered whole.
MIN_COVER, WHOLE = 0.7, 6
#: Most words of a text between two chained runs.
MAX_GAP = 40

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text: str) -> list[str]:
    """Words of one text; batches use the vectorised kernel."""
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = T.word_bounds(data, np.array([0, len(data)]), T.ALNUM)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8").translate(_LOWER) for a, b in zip(s, e)]


_LOWER = {i: i + 32 for i in range(65, 91)}


class Automaton:
    """Generalised suffix automaton of integer sequences."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for no, seq in enumerate(sequences):
            last = 0
            for at, c in enumerate(seq):
                last = self._extend(last, c)
                self.places[last].append((no, at))
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.places[self.link[s]].extend(self.places[s])

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def stream(self, seq: Sequence[int]) -> tuple[list[int], list[int]]:
        """Matching statistics: per item, the longest match ending there, and its state."""
        state = length = 0
        lengths, states = [], []
        nxt, link, longest = self.next, self.link, self.length
        for c in seq:
            while state and c not in nxt[state]:
                state = link[state]
                length = longest[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            lengths.append(length)
            states.append(state)
        return lengths, states


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, tuple[str, ...], str]], base: dict[str, str], least: int):
        self.labels = [label for label, _, _ in templates]
        tokens = [words_of(t) for _, _, t in templates]
        self.sizes = [len(t) for t in tokens]
        #: Places in its template of each part that a run must hold: [from, to) for every occurrence.
        self.telling = [[_places(t, words_of(part)) for part in parts] for t, (_, parts, _) in zip(tokens, templates)]
        self.least = least
        names = sorted({w for t in tokens for w in t} | {w for p in base for w in p.split()})
        data, offsets = T.flat(pa.array(names, pa.string()))
        hashes = T.span_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        number = {w: i for i, w in enumerate(names)}
        self.sequences = [[number[w] for w in t] for t in tokens]
        self.automaton = Automaton(self.sequences)
        self.base = [([number[w] for w in p.split()], label) for p, label in base.items()]
        self.size = len(names) + 1
        self.grams = np.unique(np.array([self._code(s[k : k + least]) for s in self.sequences for k in range(len(s) - least + 1)] or [-1], np.int64))

    def _code(self, gram: Sequence[int]) -> int:
        code = 0
        for x in gram:
            code = code * self.size + x + 1
        return code

    def token_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Template word numbers, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def runs(self, ids: Sequence[int]) -> dict[int, list[tuple[int, int, int]]]:
        """Per template, all longest runs (text place, template place, words) that it has in common with a stretch of words."""
        lengths, states = self.automaton.stream(ids)
        places, link, longest = self.automaton.places, self.automaton.link, self.automaton.length
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (n, v) in enumerate(zip(lengths, states)):
            after = ids[i + 1] if i + 1 < len(ids) else -1
            seen: set[tuple[int, int]] = set()
            while v and n >= self.least:
                for place in places[v]:
                    if place in seen:
                        continue
                    seen.add(place)
                    no, end = place
                    if end + 1 == self.sizes[no] or self.sequences[no][end + 1] != after:
                        found.setdefault(no, []).append((i - n + 1, end - n + 1, n))
                v = link[v]
                n = longest[v]
        return found

    def spans(self, ids: Sequence[int]) -> tuple[list[tuple[int, int, int, int]], float]:
        """(template, first word, end, covered words) of each place's best template in a stretch, and the greatest share covered."""
        found, top = [], 0.0
        for no, runs in self.runs(ids).items():
            covered, chain = best_chain(runs)
            size = self.sizes[no]
            top = max(top, covered / size)
            if covered < (size if size <= WHOLE else MIN_COVER * size):
                continue
            if all(any(t <= x and y <= t + n for x, y in part for _, t, n in chain) for part in self.telling[no]):
                found.append((no, chain[0][0], chain[-1][0] + chain[-1][2], covered))
        found.sort(key=lambda f: (-f[3], -f[3] / self.sizes[f[0]], f[0]))
        kept: list[tuple[int, int, int, int]] = []
        for f in found:
            if all(2 * (min(f[2], k[2]) - max(f[1], k[1])) < f[2] - f[1] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[1:]), top

    def scan(self, ids: np.ndarray) -> tuple[int, int | None, int | None, str, str, float, list[dict]]:
        """One text's result from its word numbers."""
        base, n_base, first, last = set(), 0, None, None
        n = len(ids)
        for phrase, label in self.base:
            k = len(phrase)
            if n >= k:
                hit = ids[: n - k + 1] == phrase[0]
                for j in range(1, k):
                    hit &= ids[j : n - k + 1 + j] == phrase[j]
                at = np.flatnonzero(hit)
                if len(at):
                    base.add(label)
                    n_base += len(at)
                    first = int(at[0]) if first is None else min(first, int(at[0]))
                    last = int(at[-1]) if last is None else max(last, int(at[-1]))
        labels, spans = set(base), []
        score = 1.0 if base else 0.0
        k = self.least
        if n >= k:
            code = np.zeros(n - k + 1, np.int64)
            for j in range(k):
                code = code * self.size + ids[j : n - k + 1 + j] + 1
            at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
            hits = np.flatnonzero(self.grams[at] == code)
            for a, b in _stretches(hits, k):
                got, share = self.spans(ids[a:b].tolist())
                score = max(score, share)
                for no, first_word, end, covered in got:
                    labels.add(self.labels[no])
                    spans.append({"label": self.labels[no], "first_word": a + first_word, "n_words": end - first_word, "share": covered / self.sizes[no]})
        return n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), spans


def _places(words: list[str], part: list[str]) -> list[tuple[int, int]]:
    """[from, to) of each occurrence of ``part``."""
    return [(i, i + len(part)) for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part]


def _stretches(hits: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Runs of words around hits that a chain may join."""
    if not len(hits):
        return
    cut = np.flatnonzero(np.diff(hits) > k + MAX_GAP)
    for a, b in zip(np.r_[0, cut + 1], np.r_[cut, len(hits) - 1]):
        yield int(hits[a]), int(hits[b]) + k


def best_chain(runs: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Most template words that runs cover in order, in text and template alike, and the runs so chained, cut to what they add.

    A run that follows another loses the words at its start that the other has passed in text or template; between
    two, at most ``MAX_GAP`` words of text are left out. All predecessors that end within that reach of a run's
    start, or later, are tried, so no chain of this kind covers more.
    """
    order = sorted(runs, key=lambda r: (r[0] + r[2], r[1] + r[2], -r[2]))
    ends = [a + n for a, _, n in order]
    totals, before = [], []
    for j, (a, t, n) in enumerate(order):
        total, link = n, (-1, 0)
        for i in range(bisect_left(ends, a - MAX_GAP), j):
            b, u, m = order[i]
            cut = max(0, b + m - a, u + m - t)
            if cut < n and a + cut - b - m <= MAX_GAP and totals[i] + n - cut > total:
                total, link = totals[i] + n - cut, (i, cut)
        totals.append(total)
        before.append(link)
    j = max(range(len(order)), key=lambda k: (totals[k], -k))
    best, chain = totals[j], []
    while j >= 0:
        i, cut = before[j]
        a, t, n = order[j]
        chain.append((a + cut, t + cut, n - cut))
        j = i
    return best, chain[::-1]


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, tuple[str, ...], str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = tuple(BASE.items()), least: int = MIN_MATCH) -> Scanner:
    return Scanner(templates, dict(base), least)


def scan_licences(df: DataFrame, templates: tuple[tuple[str, tuple[str, ...], str], ...] = TEMPLATES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: words, places of the base phrases, base labels, all labels, the best covered share, and the spans found."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(templates)
        for batch in batches:
            rows, n_words = [], []
            for _, _, data, offsets in T.chunks(batch.column(1)):
                s, e, w = T.word_bounds(data, offsets, T.ALNUM)
                ids = scan.token_ids(T.span_hashes(data, s, e))
                n_words += np.diff(w).tolist()
                rows += [scan.scan(ids[w[i] : w[i + 1]]) for i in range(len(w) - 1)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, n_words: bigint, share: double>>")


def op8_licence_automaton(spark, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans")
