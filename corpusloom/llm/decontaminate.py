"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of anything beyond ASCII, case-folded by Unicode; characters of
scripts that are written without spaces are words of their own. The seeds of a test item are its pairs of neighbouring words, found in a document where the two stand next to each other
or with one word between. Smith-Waterman (match 2, mismatch and gap -1, over words) scores the item against
windows of the document; the score is divided by that of a whole match, and pairs of at least
``LEAST_SCORE`` are returned with the best window's span.

No alignment that reaches ``LEAST_SCORE`` is lost. Of an item of n words, let m be matched; such an alignment
pays at most 2m - n, spans at most 2n words, and leaves out at most n - m words. Two matched neighbours are
no seed if words between them are left out (which costs 1) or two or more are put in (which costs 2), so with b
breaks of the first kind (b <= n - m and b <= 2m - n, so b <= n / 3) at most (2m - n - b) / 2 of the second
are paid for, and m - 1 - b - (2m - n - b) / 2 >= n / 3 - 1 seeds are left (``held``). Each item therefore
drops half that many of its pairs, the most frequent in the whole corpus, and a window is aligned where the
other half stand within 2n words. Windows of one document and item that overlap are one; windows that
hold too few of the item's words to reach the score are not aligned.

Items of fewer than ``LEAST_WORDS`` words align with too much to tell: they are found where all their words stand
next to each other, and score 1.

Distinct item texts are read in blocks of bounded size. Pairs of words of up to ``COUNTED`` bytes of items at a time
are counted in one scan of the corpus; then each block, with its seeds, is sent to all executors for a scan of its
own. The documents never move.

Defined results: null and empty texts and items give no pairs; long texts are scanned whole; repeated rows of either
table repeat their pairs; null ids are kept; of windows of one document and item with equal scores the first one's
span is given; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import small_batches, table, written

LEAST_WORDS = 5
MATCH, MISS, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Bytes of items aligned at once, and whose pairs are counted at once; they bound what is broadcast (some 10 bytes
#: for one of the first, 2 for one of the second).
BLOCK_BYTES, COUNTED = 16_000_000, 64_000_000
#: Characters of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, kana, bopomofo and Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Cells of alignments computed together.
CELLS = 2_000_000


def held(n: np.ndarray) -> np.ndarray:
    """Seeds that an alignment of ``LEAST_SCORE`` with an item of n words holds at least."""
    return -(-n // 3) - 1


def folded(column: pa.Array) -> pa.Array:
    """The texts case-folded, with characters that are words of their own set apart; bytes that are no UTF-8 stay."""
    out = []
    for x in column.cast(pa.binary()).to_pylist():
        if x is not None and x.isascii():
            x = x.lower()
        elif x is not None:
            t = x.decode(errors="surrogateescape").casefold()
            #: All of those characters have a byte of 0xE0 or more.
            if (np.frombuffer(x, np.uint8) >= 0xE0).any():
                t = _UNSPACED.sub(r" \g<0> ", t)
            x = t.encode(errors="surrogateescape")
        out.append(x)
    return pa.array(out, pa.binary())


def _found(grams: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``hashes`` are among the sorted ``grams``, and where there."""
    if not len(grams) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(grams, hashes), len(grams) - 1)
    hit = np.flatnonzero(grams[at] == hashes)
    return hit, at[hit]


class Items:
    """The items of a block: words, seeds in sorted order, the items of each seed, and how many seeds open a window."""

    def __init__(self, texts: list[str | None]):
        data, offsets = T.flat(folded(pa.array(texts, pa.string())))
        s, e, w = T.word_bounds(data, offsets, T.ALNUM)
        words = T.span_hashes(data, s, e)
        self.words = [words[w[i] : w[i + 1]] for i in range(len(w) - 1)]
        self.size = np.diff(w)
        self.need = held(self.size)
        grams, at = T.ngrams(words, w, 2)
        item = np.searchsorted(w, at, "right") - 1
        use = self.size[item] >= LEAST_WORDS
        self.grams, gram = np.unique(grams[use], return_inverse=True)
        self._postings(gram, item[use])
        #: Of items too short to align, by number of words: hashes of all their words, sorted, and whose they are.
        self.short = {}
        for n in range(1, LEAST_WORDS):
            own = np.flatnonzero(self.size == n)
            if len(own):
                whole = np.array([T.ngrams(self.words[i], np.array([0, n]), n)[0][0] for i in own])
                order = np.argsort(whole)
                self.short[n] = (whole[order], own[order])

    def exact(self, words: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item, 1, places, first word, last word) of each row and short item that stands in it."""
        out = []
        for n, (whole, item) in self.short.items():
            grams, at = T.ngrams(words, w, n)
            first, last = np.searchsorted(whole, grams), np.searchsorted(whole, grams, "right")
            hit = np.flatnonzero(last > first)
            row = np.searchsorted(w, at[hit], "right") - 1
            for (r, _), group in groupby(sorted(zip(row.tolist(), first[hit].tolist(), at[hit].tolist(), last[hit].tolist())), lambda x: x[:2]):
                places = list(group)
                a = places[0][2] - int(w[r])
                out += [(r, int(item[k]), 1.0, len(places), a, a + n - 1) for k in range(places[0][1], places[0][3])]
        return out

    def _postings(self, gram: np.ndarray, item: np.ndarray) -> None:
        order = np.lexsort((item, gram))
        self.item = item[order]
        self.first = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``hashes`` seeds stand, and which."""
        return _found(self.grams, hashes)

    def keep_rarest(self, counts: np.ndarray) -> None:
        """Drops half of each item's ``held`` number of pairs, the most frequent; the other half open a window."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        order = np.lexsort((gram, -counts[gram], self.item))
        own = self.item[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        keep = np.sort(order[rank >= self.need[own] // 2])
        self.need = self.need - self.need // 2
        kept, again = np.unique(gram[keep], return_inverse=True)
        self.grams = self.grams[kept]
        self._postings(again, self.item[keep])


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, words, offsets, and hash and first word of all pairs of words next to each other or with one between."""
    for i, _, data, offsets in T.chunks(folded(column)):
        s, e, w = T.word_bounds(data, offsets, T.ALNUM)
        words = T.span_hashes(data, s, e)
        near, at = T.ngrams(words, w, 2)
        room = np.repeat(w[1:], np.diff(w)) - np.arange(len(words))
        far = np.flatnonzero(room >= 3)
        yield i, words, w, np.concatenate([near, T.pair(words[far], words[far + 2])]), np.concatenate([at, far])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each item in its window, and the item and window word where it ends."""
    n, m = max(map(len, items)), max(map(len, windows))
    b = len(items)
    x, y = np.zeros((b, n), np.uint64), np.zeros((b, m), np.uint64)
    has_x, has_y = np.zeros((b, n), bool), np.zeros((b, m), bool)
    for k, (i, w) in enumerate(zip(items, windows)):
        x[k, : len(i)], y[k, : len(w)] = i, w
        has_x[k, : len(i)], has_y[k, : len(w)] = True, True
    row = np.zeros((b, m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    best, end_x, end_y = np.zeros(b, np.int32), np.zeros(b, np.int64), np.zeros(b, np.int64)
    for i in range(n):
        same = (x[:, i : i + 1] == y) & has_y & has_x[:, i : i + 1]
        now = np.maximum(row + GAP, 0)
        np.maximum(now[:, 1:], row[:, :-1] + np.where(same, MATCH, MISS).astype(np.int32), out=now[:, 1:])
        row = np.maximum.accumulate(now + slope, axis=1) - slope
        top = row.argmax(1)
        value = row[np.arange(b), top]
        better = (value > best) & has_x[:, i]
        best[better], end_x[better], end_y[better] = value[better], i, top[better] - 1
    return best, end_x, end_y


def _score(items: Items, jobs: list[tuple[int, int, int, int, np.ndarray]]) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, score, seeds, first word, last word) of the best window of each row and item."""
    found: dict[tuple[int, int], tuple] = {}
    jobs.sort(key=lambda j: (len(items.words[j[1]]), len(j[4])))
    i = 0
    while i < len(jobs):
        k, wide = i, 1
        while k < len(jobs) and (k == i or (k - i + 1) * max(wide, len(jobs[k][4])) <= CELLS // 8):
            wide = max(wide, len(jobs[k][4]))
            k += 1
        part = jobs[i:k]
        best, ex, ey = align([items.words[j[1]] for j in part], [j[4] for j in part])
        good = [q for q, j in enumerate(part) if best[q] >= LEAST_SCORE * MATCH * len(items.words[j[1]])]
        if good:
            back = align([items.words[part[q][1]][: ex[q] + 1][::-1] for q in good], [part[q][4][: ey[q] + 1][::-1] for q in good])
            for q, length in zip(good, back[2]):
                row, item, seeds, at, _ = part[q]
                score = float(best[q]) / (MATCH * len(items.words[item]))
                old = found.get((row, item))
                total = seeds + (old[1] if old else 0)
                span = (at + int(ey[q] - length), at + int(ey[q]))
                if old is None or (score, -span[0]) > (old[0], -old[2]):
                    found[row, item] = (score, total, *span)
                else:
                    found[row, item] = (old[0], total, *old[2:])
        i = k
    return [(r, it, *v) for (r, it), v in sorted(found.items())]


def _jobs(items: Items, words: np.ndarray, w: np.ndarray, grams: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(row, item, seeds, first word, words) of each window worth aligning."""
    hit, gram = items.find(grams)
    if not len(hit):
        return []
    n = items.first[gram + 1] - items.first[gram]
    which = np.repeat(items.first[gram] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
    item, pos = items.item[which], np.repeat(at[hit], n)
    order = np.lexsort((item, pos))
    item, pos = item[order], pos[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (pos[1:] != pos[:-1])]
    item, pos = item[new], pos[new]
    row = np.searchsorted(w, pos, "right") - 1
    order = np.lexsort((pos, item, row))
    row, item, pos = row[order], item[order], pos[order]
    reach = 2 * items.size[item]
    last = np.arange(len(pos)) + items.need[item] - 1
    end = np.minimum(last, len(pos) - 1)
    opens = np.flatnonzero((last == end) & (row[end] == row) & (item[end] == item) & (pos[end] - pos < reach))
    lo, hi = np.maximum(pos - reach + 1, w[row])[opens], np.minimum(pos + reach, w[row + 1])[opens]
    out, k = [], 0
    row, item, lo, hi = (v.tolist() for v in (row[opens], item[opens], lo, hi))
    while k < len(row):
        r, it, a, b, seeds = row[k], item[k], lo[k], hi[k], 1
        k += 1
        while k < len(row) and row[k] == r and item[k] == it and lo[k] <= b:
            b = max(b, hi[k])
            seeds += 1
            k += 1
        own, window = items.words[it], words[a:b]
        if int(np.isin(own, window).sum()) >= LEAST_SCORE * len(own):
            out.append((r, it, seeds, a - int(w[r]), window))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, tkey, item, item_words, score, seeds, first_word, last_word) of every document and item that align.

    ``tkey`` is the hash of the document's text, ``seeds`` the number of places that opened its windows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.md5(F.col(item_text).cast("binary")).alias("key"), F.col(item_text).alias("words")).where("words IS NOT NULL")
    texts = written(items.groupBy("key").agg(F.first("words").alias("words")), "items")
    size = texts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, ceil(size / COUNTED))
    blocks = parts * max(1, ceil(size / parts / BLOCK_BYTES))
    texts = written(texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))), "items")
    found = None
    for part in range(parts):
        held = [texts.where(F.col("block") == k).select("key", "words").toArrow() for k in range(part, blocks, parts)]
        for more in _aligned(docs, [(t["key"].to_pylist(), t["words"].to_pylist()) for t in held], id_col, text):
            found = more if found is None else found.unionByName(more)
    return found.join(items.select("key", "item"), "key").select("doc", "tkey", "item", "item_words", "score", "seeds", "first_word", "last_word")


def _counted(docs: DataFrame, grams: np.ndarray, text: str) -> np.ndarray:
    """How often each of the sorted ``grams`` stands in the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, _, _, seen, _ in _grams(batch.column(0)):
                total += np.bincount(_found(sent.value, seen)[1], minlength=len(total))
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 100_000]), pa.array(total[some[k : k + 100_000]])], ["gram", "n"])

    #: As many rows as there are grams, at most, 16 bytes each.
    got = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(grams), np.int64)
    counts[got["gram"].to_numpy()] = got["n"].to_numpy()
    return counts


def _aligned(docs: DataFrame, parts: list[tuple[list[str], list[str]]], id_col: str, text: str) -> Iterator[DataFrame]:
    """For each block of (keys, texts), the pairs of documents and items that align."""
    context = docs.sparkSession.sparkContext
    blocks = [Items(texts) for _, texts in parts]
    grams = np.unique(np.concatenate([b.grams for b in blocks]))
    counts = _counted(docs, grams, text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text, F.xxhash64(text).alias("tkey"))
    for block, (keys, _) in zip(blocks, parts):
        block.keep_rarest(counts[np.searchsorted(grams, block.grams)])
        seeds = context.broadcast((block, keys))

        def find(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            items, names = seeds.value
            for batch in batches:
                for i, words, w, grams, at in _grams(batch.column(1)):
                    got = _score(items, _jobs(items, words, w, grams, at)) + items.exact(words, w)
                    if got:
                        row, item, score, n, a, b = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(at_row := pa.array(np.array(row) + i)), batch.column(2).take(at_row), pa.array([names[x] for x in item], pa.string()), pa.array([int(items.size[x]) for x in item], pa.int32()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                            ["doc", "tkey", "key", "item_words", "score", "seeds", "first_word", "last_word"],
                        )

        yield rows.mapInArrow(find, "doc long, tkey long, key string, item_words int, score double, seeds long, first_word long, last_word long")


def op1_benchmark_alignment(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("tkey", "item_words").withColumnsRenamed({"doc": "doc_id", "item": "item_id", "seeds": "n_seeds"})
