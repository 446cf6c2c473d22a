"""Paragraph deduplication by MinHash banding.

Paragraphs are the runs of a text between newlines of at least ``WORDS`` words (outside ASCII white space, A-Z
lowered). A paragraph's set holds its distinct ``SHINGLE``-word shingles. Equal sets are one; ``BANDS`` bands of
``ROWS`` MinHash values give each a key per band, and sets that collide in a band are candidates: at the
threshold a pair shares no band with probability (1 - 0.75^3)^12 = 0.0014. Of 16 bits of other bands' values a
candidate needs ``LEAST_BITS`` in common. Colliding sets meet their next ``WINDOW`` neighbours in order of those
bits; keys with more sets are contracted by component and met again while that finds links, and then the sets
outside a key's largest component are held against all of the key, by sketch and in full. Exact Jaccard on the
full sets confirms each link, and components of links are the classes.

Newlines say little about where a repeated passage starts, so each text has paragraphs by content as well:
``WORDS`` words from an anchor on, where the anchors are the places of least word-pair number, leftmost of
equals, in each ``EVERY`` neighbouring places (in all places of a text of fewer). Any passage of
``WORDS + EVERY - 1`` words that stands in two texts, however deep inside longer paragraphs, thus has a whole one in
common in both; they overlap or touch, so they cover it without holes. Those are alike if their words are, and
need no bands. Boilerplate of fewer than ``WORDS`` words fills neither kind.

The first paragraph of a class by (document id, place, text hash) stays, with what overlaps it in its own text;
all others are repeats. Overlapping or touching paragraphs of classes with repeats are one passage, and the words
that its repeats cover are its removals.

Defined results: null and empty texts and those of fewer than ``WORDS`` words have no paragraphs and stay;
repeated rows (equal id and text) are one; a null id counts after all others; long texts are used whole; an
empty table gives no rows. Sets are known by 63-bit hashes of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._links import BROADCAST_IDS, _gathered, met, settled
from ._spark import discard, small_batches, spread_join, table, written
from .forest import PERCENT, binary, lists, minhashes, reaches, set_ids, sets_of

WORDS, EVERY, SHINGLE = 26, 26, 3
BANDS, ROWS, WINDOW = 12, 3, 12
#: A row of a band is one long: 4 bits of its number, 43 of its key, and the lowest bits of 16 values of other bands,
#: of which pairs with fewer in common than ``LEAST_BITS`` are no candidates: at the threshold 14 are expected.
KEY_BITS, KEY, MORE_BITS, LEAST_BITS = 43, 6, 16, 9
SIG = BANDS * KEY + -(-BANDS * ROWS // 8)
#: One-byte values of the sketch of a set of a crowded key, and how many a pair needs in common to be verified:
#: at the threshold 36 are expected, with a deviation of 3.
SKETCH, LEAST_SAME = 48, 20
LAST = 2**63 - 1

_seeds = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_MULTIPLY, _ADD = _seeds[0] | np.uint64(1), _seeds[1]
_others = np.random.Generator(np.random.PCG64(10)).integers(1, 2**63, (2, SKETCH), dtype=np.uint64)
_SPREAD = 2**31 - 1
_WEIGHTS = np.arange(1, 65, dtype=np.int64) ** 2 * 7919 + np.arange(1, 65, dtype=np.int64) * 104729
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32


def word_values(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the hash that ``span_hashes`` gives, and a number below 2^31 - 1 that SQL can compute: bytes, weighted by place modulo 64, summed up."""
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = e - s
    before = np.r_[0, np.cumsum(size)[:-1]]
    own = data[T.SPACED[data]]
    at = np.arange(len(own)) - np.repeat(before, size)
    number = np.add.reduceat(_FOLD[own] * _WEIGHTS[at & 63], before) % _SPREAD
    codes = T._FOLDED_CODES[own]
    codes *= T.powers(int(size.max()))[at]
    return T.mix(np.add.reduceat(codes, before) + size.astype(np.uint64)), number


def anchors(numbers: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of all anchors, in order, given words' numbers and texts' word offsets."""
    n = len(numbers)
    if n < WORDS:
        return np.zeros(0, np.int64)
    value = (numbers[:-1] * 48271 + numbers[1:] * 69621) % _SPREAD
    least = (value << 32) | np.arange(n - 1)
    size = np.diff(w)
    room = np.repeat(w[1:], size) - np.arange(n)
    few = (size >= WORDS) & (size < WORDS + EVERY - 1)
    edges = np.stack([w[:-1][few], w[1:][few] - WORDS + 1], axis=1).ravel()
    out = [np.minimum.reduceat(np.r_[least, 0], edges)[::2]] if len(edges) else []
    span = 1
    while span * 2 <= EVERY:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < EVERY and len(least) > EVERY - span:
        least = np.minimum(least[: len(least) - (EVERY - span)], least[EVERY - span :])
    out.append(least[np.flatnonzero(room[: len(least)] >= WORDS + EVERY - 1)])
    return np.unique(np.concatenate(out) & (2**32 - 1))


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size`` neighbouring words, put together from runs of powers of two."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out, done, power, span = None, 0, words, 1
    while done < size:
        if size & span:
            out = power[: len(words) - size + 1] if out is None else T.pair(out, power[done : done + len(words) - size + 1])
            done += span
        if done < size:
            power, span = T.pair(power[: len(power) - span], power[span:]), 2 * span
    return T.mix(out)


def sets_cut(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat shingle sets of given stretches of words, and their offsets."""
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    before = np.r_[0, np.cumsum(size)]
    return sets_of(words[np.repeat(first - before[:-1], size) + np.arange(before[-1])], before, SHINGLE)


def lines(data: np.ndarray, offsets: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each paragraph between newlines that takes part."""
    starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    first = np.searchsorted(s, starts)
    size = np.diff(np.r_[first, len(s)])
    return first[size >= WORDS], size[size >= WORDS]


def band_keys(flat: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """``KEY`` bytes per set and band, and the lowest bits of all values."""
    sig = minhashes(flat, cut, _MULTIPLY, _ADD)
    key = sig[:, ::ROWS]
    for k in range(1, ROWS):
        key = T.pair(key, sig[:, k::ROWS])
    key = np.ascontiguousarray(T.mix(key) >> np.uint64(64 - KEY_BITS)).view(np.uint8).reshape(-1, BANDS, 8)[:, :, :KEY]
    return np.concatenate([key.reshape(-1, BANDS * KEY), np.packbits((sig & np.uint64(1)).astype(bool), axis=1, bitorder="little")], axis=1)


def band_rows(raw: bytes) -> np.ndarray:
    """One long per set and band from the bytes of ``band_keys``."""
    whole, many = np.frombuffer(raw, np.uint8).reshape(-1, SIG), BANDS * ROWS
    key = np.zeros((len(whole), BANDS, 8), np.uint8)
    key[:, :, :KEY] = whole[:, : BANDS * KEY].reshape(-1, BANDS, KEY)
    bits = np.zeros((len(whole), 8), np.uint8)
    bits[:, : SIG - BANDS * KEY] = whole[:, BANDS * KEY :]
    #: A band's own values come last of all, beyond the bits that are taken.
    turn = ROWS * (np.arange(BANDS) + 1)
    bits = bits.view(np.int64)
    more = ((bits >> turn) | (bits << (many - turn))) & ((1 << MORE_BITS) - 1)
    return (np.arange(BANDS) << (KEY_BITS + MORE_BITS)) | (key.view(np.int64)[:, :, 0] << MORE_BITS) | more


def paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per paragraph: doc, tkey (hash of the text), word (its first), n (words), rid (identity) and bands (its set's keys, null for paragraphs by content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in T.chunks(batch.column(1)):
                s, e, w = T.word_bounds(data, offsets)
                words, numbers = word_values(data, s, e)
                at = anchors(numbers, w)
                yield rows(batch, i, w, at, np.full(len(at), WORDS), (runs_of(words, WORDS)[at] >> np.uint64(1)).astype(np.int64), pa.nulls(len(at), pa.binary()))
                first, size = lines(data, offsets, s)
                flat, cut = sets_cut(words, first, size)
                yield rows(batch, i, w, first, size, set_ids(flat, cut), binary(band_keys(flat, cut)))

    def rows(batch: pa.RecordBatch, i: int, w: np.ndarray, first: np.ndarray, size: np.ndarray, rid: np.ndarray, bands: pa.Array) -> pa.RecordBatch:
        doc = np.searchsorted(w, first, "right") - 1
        own = pa.array(doc + i)
        return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(2).take(own), pa.array((first - w[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(rid), bands], ["doc", "tkey", "word", "n", "rid", "bands"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text, F.xxhash64(text).alias("tkey")).mapInArrow(run, "doc long, tkey long, word int, n int, rid long, bands binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, rid) of each set and band; sets that repeat nearby give one row."""
    for batch in _gathered(batches, 50_000):
        rid, one = np.unique(batch.column(0).to_numpy(), return_index=True)
        keys = band_rows(b"".join(batch.column(1).take(pa.array(one)).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rid, BANDS))], ["s", "rid"])


MET = "kind int, a long, b long, s long"


def _meeting(window: int):
    """A function over batches of (s, rid) in order, for ``mapInArrow``: candidate pairs (kind 0), rows at the partition's edges (1) and of crowded keys (2)."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray | None, s: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), none if b is None else pa.array(b), none if s is None else pa.array(s)], ["kind", "a", "b", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, rid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = True
        for batch in _gathered(batches, 100_000):
            fresh = len(s)
            s, rid = np.r_[s, batch.column(0).to_numpy()], np.r_[rid, batch.column(1).to_numpy()]
            new = np.r_[True, (s[1:] != s[:-1]) | (rid[1:] != rid[:-1])]
            fresh = int(new[:fresh].sum())
            s, rid = s[new], rid[new]
            key = s >> MORE_BITS
            alike = np.flatnonzero(key[1:] == key[:-1])
            dense = np.zeros(len(s), bool)
            for k in range(1, window + 1):
                if k > 1:
                    alike = alike[alike + k < len(s)]
                    alike = alike[key[alike] == key[alike + k]]
                if not len(alike):
                    break
                x = alike[alike + k >= fresh]
                if k == window:
                    for q in range(window + 1):
                        dense[x + q] = True
                x = x[(rid[x] != rid[x + k]) & (np.bitwise_count(s[x] ^ s[x + k]) <= MORE_BITS - LEAST_BITS)]
                if len(x):
                    yield rows(0, np.minimum(rid[x], rid[x + k]), np.maximum(rid[x], rid[x + k]), None)
            if dense.any():
                yield rows(2, rid[dense], None, s[dense])
            if first:
                yield rows(1, rid[:window], None, s[:window])
                first = False
            s, rid = s[-window:], rid[-window:]
        if len(s):
            yield rows(1, rid, None, s)

    return run


def colliding(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs of the bands' rows, and the rows of keys with more than ``WINDOW`` sets."""
    found = met(bands, ["s", "rid"], _meeting(WINDOW), MET, lambda x: x.select("s", F.col("a").alias("rid")))
    pairs = written(found.where("kind = 0").groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("same")), "pairs")
    order = F.unhex(F.lpad(F.hex("s"), 16, "0"))
    dense = found.where("kind = 2").select(F.lit(0).alias("tree"), order.alias("s"), F.col("a").alias("rid"), F.lit(1).alias("n"), F.unhex(F.lit("")).alias("sketch"))
    return pairs, written(dense.distinct(), "crowded")


def sketches(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``SKETCH`` bytes per set."""
    return (minhashes(flat, offsets, _others[0] | np.uint64(1), _others[1]) >> np.uint64(32)).astype(np.uint8)


def _bodies(docs: DataFrame, units: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(rid, body): the set of each wanted identity, cut from one of the texts that hold it."""
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_IDS
    small = F.broadcast if few else (lambda x: x)
    #: Rows without an id are spread by the hash of their text; one that equals an id only fetches one text more.
    key = F.when(F.col("doc") == LAST, F.col("tkey")).otherwise(F.col("doc"))
    one = units.join(small(wanted), "rid").groupBy("rid").agg(F.min(F.struct("doc", "tkey", "word", "n")).alias("one")).select("rid", "one.*")
    chosen = written(one.groupBy(key.alias("_doc"), F.col("tkey").alias("_tkey")).agg(F.collect_list(F.struct("rid", "word", "n")).alias("_wanted")), "chosen")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("_doc"), F.xxhash64(text).alias("_tkey"), F.col(text).alias("_text"))
    texts = texts.join(small(chosen), ["_doc", "_tkey"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.chunks(batch.column(0)):
                s, e, w = T.word_bounds(data, offsets)
                held = batch.column(1).slice(i, j - i)
                wanted = held.flatten()
                first = wanted.field("word").to_numpy() + np.repeat(w[:-1], np.diff(held.offsets.to_numpy()))
                flat, cut = sets_cut(T.span_hashes(data, s, e), first, wanted.field("n").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([wanted.field("rid"), lists(flat, cut)], ["rid", "body"])

    whole = texts.select("_text", "_wanted").mapInArrow(run, "rid long, body binary")
    return written(whole.groupBy("rid").agg(F.first("body").alias("body")), "bodies")


LATE = {"sketch": sketches, "sketch_bytes": SKETCH, "least_same": LEAST_SAME}


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every paragraph of a class with repeats: doc, tkey, word, n, first (of its class: doc, word, tkey, n), copies, gone (a repeat)."""
    small_batches(docs.sparkSession)
    cut = written(paragraphs(docs, id_col, text), "paragraphs")
    units, sets = cut.drop("bands"), cut.where("bands IS NOT NULL")
    found = colliding(sets.select("rid", "bands").mapInArrow(_bands, "s long, rid long"))
    shape = {"prefix": 6, "s_bytes": 8, "sketch_bytes": 0, "least_same": 0, "window": WINDOW, "ratio": PERCENT / 100}
    _, comp = settled(found, lambda wanted: _bodies(docs, sets.drop("bands"), wanted, id_col, text), reaches, shape, LATE)
    per = units.groupBy("rid").agg(F.min(F.struct("doc", "word", "tkey", "n")).alias("first"), F.count(F.lit(1)).alias("own"))
    alike = per.join(comp.withColumnRenamed("id", "rid"), "rid", "left").where("own > 1 OR comp IS NOT NULL")
    alike = written(alike, "classed")
    #: A set without links is a class of its own, so only linked ones look for the first of their class.
    joined = alike.where("comp IS NOT NULL")
    joined = joined.select("rid", "comp", "own").join(joined.groupBy("comp").agg(F.min("first").alias("first")), "comp")
    classed = joined.unionByName(alike.where("comp IS NULL").withColumn("comp", F.col("rid")))
    rows = spread_join(units, classed, ["rid"], "own", ["doc", "tkey", "word"], units.count(), once=True).drop("own", "rid")
    apart = (F.col("word") >= F.col("first.word") + F.col("first.n")) | (F.col("first.word") >= F.col("word") + F.col("n"))
    rows = written(rows.withColumn("gone", (F.col("doc") != F.col("first.doc")) | (F.col("tkey") != F.col("first.tkey")) | apart), "repeats")
    sizes = rows.groupBy("comp").agg((F.sum(F.col("gone").cast("long")) + 1).alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 1")
    out = spread_join(rows, sizes, ["comp"], "rows", ["doc", "tkey", "word"], rows.count()).drop("comp", "rows")
    discard(cut)
    return out


PASSAGE = "doc long, tkey long, first_word int, n_words int, n_removed int, class_doc long, class_word int, copies long, removed array<struct<a:int,b:int>>"


def _together(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each run of overlapping or touching stretches [a, b) of one text, given in order of texts and starts, and the runs' ends."""
    upto = np.maximum.accumulate((text << 40) + b)
    first = np.flatnonzero(np.r_[True, (text[1:] << 40) + a[1:] > upto[:-1]]) if len(a) else np.zeros(0, np.int64)
    return first, upto[np.r_[first[1:], len(a)][: len(first)] - 1] - (text[first] << 40)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of each text from its sorted paragraphs."""
    for batch in batches:
        units = batch.column(2)
        flat = units.flatten()
        text = np.repeat(np.arange(len(units)), np.diff(units.offsets.to_numpy()))
        a = flat.field("word").to_numpy().astype(np.int64)
        b = a + flat.field("n").to_numpy()
        first, ends = _together(text, a, b)
        gone = np.flatnonzero(flat.field("gone").to_numpy(zero_copy_only=False))
        cut, cut_ends = _together(text[gone], a[gone], b[gone])
        cut_from = a[gone][cut]
        owner = np.searchsorted(first, gone[cut], "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(cut_from.astype(np.int32)), pa.array(cut_ends.astype(np.int32))], ["a", "b"])
        lists_of = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)), spans)
        removed = np.bincount(owner, cut_ends - cut_from, len(first)).astype(np.int32)
        own, at = pa.array(text[first]), pa.array(first)
        of = flat.field("first")
        names = ["doc", "tkey", "first_word", "n_words", "n_removed", "class_doc", "class_word", "copies", "removed"]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(a[first].astype(np.int32)), pa.array((ends - a[first]).astype(np.int32)), pa.array(removed), of.field("doc").take(at), of.field("word").take(at), flat.field("copies").take(at), lists_of], names)


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every passage of repeated paragraphs: doc, tkey, its words, how many go and which (``removed``, spans of words), and of its first paragraph's class the first document and word and the number of copies."""
    units = repeated_paragraphs(docs, id_col, text)
    #: A text's list is as long as the text at most, and holds each paragraph once.
    each = units.groupBy("doc", "tkey").agg(F.array_sort(F.collect_list(F.struct("word", "n", "first", "gone", "copies"))).alias("units"))
    return each.mapInArrow(_joined, PASSAGE)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and text of every row, without the words of its removals and what parts them from the next word."""
    spans = duplicate_passages(docs, id_col, text).where("n_removed > 0").groupBy("doc", "tkey").agg(F.array_sort(F.flatten(F.collect_list("removed"))).alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(text).alias("_tkey"))
    rows = rows.join(spans.withColumnsRenamed({"doc": "_doc", "tkey": "_tkey"}), ["_doc", "_tkey"], "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if spans:
                    whole = raw.encode()
                    s, _, _ = T.word_bounds(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
                    s = np.r_[s, len(whole)]
                    edges = [0, *(int(s[x]) for span in spans for x in (span["a"], span["b"])), len(whole)]
                    raw = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc", "text"])

    return rows.mapInArrow(run, "doc long, text string")


def op9_paragraph_bands(spark, sf_dir: str) -> DataFrame:
    found = duplicate_passages(table(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.select(real("doc").alias("doc_id"), "first_word", "n_words", "n_removed", real("class_doc").alias("class_doc_id"), "class_word", "copies", (F.col("n_removed") == 0).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
q AS (SELECT doc_id, unnest(string_split(t, chr(10))) t, unnest(range(len(string_split(t, chr(10))))) para FROM t),
w AS MATERIALIZED (SELECT doc_id, para, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM q),
pa AS MATERIALIZED (SELECT doc_id, para, len(ws) n, ws, (sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY para) - len(ws))::INTEGER word FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(ws) v, word + unnest(range(len(ws))) p FROM pa),
h AS MATERIALIZED (SELECT v, list_sum(list_transform(range(strlen(v)), lambda i: ('0x' || substr(hex(v), 2 * i + 1, 2))::BIGINT * ((i % 64 + 1) * (i % 64 + 1) * 7919 + (i % 64 + 1) * 104729)))::BIGINT % 2147483647 k FROM (SELECT DISTINCT v FROM x)),
o AS MATERIALIZED (SELECT doc_id, p, v, k, lead(k) OVER d k2, count(*) OVER (PARTITION BY doc_id) n FROM x JOIN h USING (v) WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
m AS (SELECT doc_id, p, n, min((k * 48271 + k2 * 69621) % 2147483647 * 4294967296 + p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING) least FROM o WHERE p <= n - 26),
u AS (SELECT DISTINCT doc_id, (least % 4294967296)::INTEGER word FROM m WHERE p + 25 <= n - 26 OR p = 0),
c AS MATERIALIZED (SELECT u.doc_id, u.word, string_agg(o.v, ' ' ORDER BY o.p) v FROM u JOIN o ON o.doc_id = u.doc_id AND o.p BETWEEN u.word AND u.word + 25 GROUP BY u.doc_id, u.word),
g AS MATERIALIZED (SELECT doc_id, word, n, list_sort(list_distinct(list_transform(range(1, n - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) ss FROM pa WHERE n >= 26),
ids AS MATERIALIZED (SELECT ss, row_number() OVER () id, len(ss) n FROM (SELECT DISTINCT ss FROM g)),
sh AS MATERIALIZED (SELECT id, n, unnest(ss) s FROM ids),
l AS MATERIALIZED (SELECT a.id x, b.id y FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x id, x root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
cc AS (SELECT id, min(root) comp FROM r GROUP BY id),
a AS MATERIALIZED (SELECT g.doc_id, g.word, g.n, coalesce(cc.comp, ids.id)::VARCHAR comp FROM g JOIN ids ON ids.ss = g.ss LEFT JOIN cc ON cc.id = ids.id
  UNION ALL SELECT doc_id, word, 26, '=' || v FROM c),
f AS (SELECT a.*, first_value(doc_id) OVER z fd, first_value(word) OVER z fw, first_value(n) OVER z fn FROM a WINDOW z AS (PARTITION BY comp ORDER BY doc_id, word)),
b AS (SELECT *, NOT (doc_id = fd AND word < fw + fn AND fw < word + n) gone FROM f),
k AS MATERIALIZED (SELECT * FROM (SELECT *, sum(gone::INTEGER) OVER (PARTITION BY comp) + 1 copies FROM b) WHERE copies > 1),
i AS (SELECT *, CASE WHEN word <= max(word + n) OVER (PARTITION BY doc_id ORDER BY word, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END new FROM k),
j AS MATERIALIZED (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY word, n ROWS UNBOUNDED PRECEDING) no FROM i),
z AS (SELECT doc_id, no, count(DISTINCT p) gone FROM (SELECT doc_id, no, unnest(range(word, word + n)) p FROM j WHERE gone) GROUP BY doc_id, no)
SELECT j.doc_id, min(word)::INTEGER AS first_word, (max(word + n) - min(word))::INTEGER AS n_words, coalesce(any_value(z.gone), 0)::INTEGER AS n_removed,
  arg_min(fd, (word, n, fd, fw)) AS class_doc_id, arg_min(fw, (word, n, fd, fw))::INTEGER AS class_word, arg_min(copies, (word, n, fd, fw))::BIGINT AS copies, coalesce(any_value(z.gone), 0) = 0 AS kept
FROM j LEFT JOIN z ON z.doc_id = j.doc_id AND z.no = j.no GROUP BY j.doc_id, j.no
"""
