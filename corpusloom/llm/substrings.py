"""Exact substring deduplication: every byte covered by a string of ``LENGTH`` bytes that starts twice.

Each window of ``LENGTH`` bytes has an anchor, its ``ANCHOR``-byte string of least hash (the leftmost of
equals). Equal windows have equal anchors at equal offsets, so repeats can only be found among the windows
of one anchor. A run is the string spanned by neighbouring windows of one anchor place. Runs are counted by
anchor and content: all windows of a run that occurs twice repeat. Where different runs share an anchor, one
of each is fetched, runs that no other run can match over ``LENGTH`` bytes around the anchor are put
aside, and suffix arrays of the rest (``suffixes``, linear grouping) show which windows repeat. Anchors with
more than ``CROWD`` different runs are settled by counting their windows' 128-bit hashes across the
cluster, so no group is ever held by one task.

Results depend on a text alone, so texts are known by their MD5 (128 bits) and copies share their spans.
Defined results: null and empty texts have no bytes, no spans, and the digest of nothing; texts below
``LENGTH`` bytes are never changed; matches never cross texts; repeated rows are repeats of each other; null
ids are kept; long texts are used whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._links import BROADCAST_IDS
from ._spark import discard, small_batches, spread_join, table, written
from .suffixes import suffix_array

LENGTH, ANCHOR = 200, 40
#: Different runs of one anchor that one task sorts at once.
CROWD = 1000
_PLACE = np.uint64((1 << 34) - 1)
_INVERSE = pow(T._BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 22, 1 << n.bit_length())
    if size not in _POWERS:
        both = []
        for base in (T._BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash, and inverse powers."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T._BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return total, down


def _hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (total[end] - total[start]) * down[start]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per run: text, first window, number of windows, anchor's offset, anchor hash and content hash."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < LENGTH:
        return none
    total, down = _prefix(data)
    m = n - ANCHOR + 1
    h = T.mix((total[ANCHOR:] - total[:m]) * down[:m])
    least = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
    width = LENGTH - ANCHOR + 1
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & _PLACE).astype(np.int64)
    fit = np.repeat(offsets[1:], np.diff(offsets))[: len(at)] - np.arange(len(at)) >= LENGTH
    good = np.flatnonzero(fit)
    if not len(good):
        return none
    a = at[good]
    new = np.r_[True, (a[1:] != a[:-1]) | (np.diff(good) > 1)]
    first = good[new]
    size = np.diff(np.r_[np.flatnonzero(new), len(good)])
    a = a[new]
    content = T.mix(_hash(total, down, first, first + size - 1 + LENGTH) + (size + 1000 * (a - first)).astype(np.uint64))
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], size, a - first, h[a], content


RUN = "tkey binary, first int, windows int, off int, anchor long, content long"


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, offsets in T.chunks(batch.column(1)):
            doc, first, size, off, anchor, content = runs(data, offsets)
            if len(doc):
                cols = [batch.column(0).take(pa.array(doc + i)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["tkey", "first", "windows", "off", "anchor", "content"])


def _reach(group: np.ndarray, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per row the longest common prefix with any other row of its group; ``rows`` are padded with zeros."""
    m, w = rows.shape
    key = np.concatenate([group.astype(">u8").view(np.uint8).reshape(m, 8), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"V{w + 8}").ravel(), kind="stable")
    same = rows[order][1:] == rows[order][:-1]
    inside = np.arange(w) < np.minimum(length[order][1:], length[order][:-1])[:, None]
    lcp = np.where((same & inside).all(1), w, (same & inside).argmin(1))
    lcp[group[order][1:] != group[order][:-1]] = -1
    best = np.full(m, -1)
    best[order[1:]] = lcp
    best[order[:-1]] = np.maximum(best[order[:-1]], lcp)
    return best


def repeated_windows(group: np.ndarray, strings: list[bytes], offs: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per string, the [from, to) ranges of window starts that another string of its group also holds.

    Strings of a group hold its anchor at ``offs``. Those whose longest matches to the left and right of
    the anchor don't add up to a window can't repeat; the others are cut to those matches and sorted.
    """
    m = len(strings)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    width = 2 * LENGTH
    right, left = np.zeros((m, width), np.uint8), np.zeros((m, width), np.uint8)
    sizes = np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        x = np.frombuffer(s, np.uint8)
        o = int(offs[i])
        right[i, : len(x) - o] = x[o:]
        left[i, :o] = x[:o][::-1]
    r = _reach(group, right, sizes - offs)
    ell = _reach(group, left, offs)
    able = np.flatnonzero((r + ell >= LENGTH) & (r >= 0))
    able = able[np.argsort(group[able], kind="stable")]
    for part in np.split(able, np.flatnonzero(np.diff(group[able])) + 1):
        if len(part) > 1:
            lo = offs[part] - ell[part]
            hi = offs[part] + r[part]
            for i, at, starts in zip(part, lo, _sorted_repeats([strings[i][a:b] for i, a, b in zip(part, lo, hi)])):
                out[i] = [(int(a + at), int(b + at)) for a, b in starts]
    return out


def _sorted_repeats(strings: list[bytes]) -> list[list[tuple[int, int]]]:
    """Ranges of starts of strings of ``LENGTH`` bytes that start twice in all of ``strings``."""
    m = len(strings)
    symbols: list[int] = []
    begins = []
    for i, s in enumerate(strings):
        begins.append(len(symbols))
        symbols.extend(b + m + 1 for b in s)
        symbols.append(i + 1)
    order = np.array(suffix_array(symbols))
    flat = np.array(symbols)
    n = len(flat)
    which = np.repeat(np.arange(m), [len(s) + 1 for s in strings])
    ends = np.array(begins) + [len(s) for s in strings]
    order = order[ends[which[order]] - order >= LENGTH]
    hit = np.zeros(n, bool)
    for k in range(0, len(order) - 1, 2000):
        a, b = order[k : k + 2000], order[k + 1 : k + 2001]
        a = a[: len(b)]
        same = (flat[a[:, None] + np.arange(LENGTH)] == flat[b[:, None] + np.arange(LENGTH)]).all(1)
        hit[a[same]] = True
        hit[b[same]] = True
    out = []
    for i, s in enumerate(strings):
        own = np.r_[False, hit[begins[i] : begins[i] + len(s)], False]
        edge = np.flatnonzero(own[1:] != own[:-1])
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


STRING = "anchor long, tkey binary, first int, off int, s binary"
FOUND = "tkey binary, a int, b int"


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; whole groups are worked on together, many at a time."""
    held: list[tuple] = []

    def work(rows: list[tuple]) -> pa.RecordBatch:
        _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        got = repeated_windows(group, [r[4] for r in rows], np.array([r[3] for r in rows]))
        flat = [(r[1], r[2] + a, r[2] + b - 1 + LENGTH) for r, spans in zip(rows, got) for a, b in spans]
        cols = list(zip(*flat)) if flat else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["tkey", "a", "b"])

    for batch in batches:
        held += list(zip(*(c.to_pylist() for c in batch.columns)))
        if len(held) > 8000:
            cut = len(held) - 1
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield work(held[:cut])
                held = held[cut:]
    if held:
        yield work(held)


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the wanted runs of each text."""
    for batch in batches:
        rows = []
        for tkey, raw, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = raw.encode()
            rows += [(w["anchor"], tkey, w["first"], w["off"], data[w["first"] : w["first"] + w["windows"] - 1 + LENGTH]) for w in wanted]
        if rows:
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "tkey", "first", "off", "s"])


def _crowded(rows: DataFrame) -> DataFrame:
    """Spans of repeated windows of anchors too crowded for one task, by counting windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tkey, first, s in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(s) - LENGTH + 1
                digests = [hashlib.blake2b(s[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([tkey] * n, pa.binary()), pa.array(range(first, first + n), pa.int32()), pa.array(digests, pa.binary())], ["tkey", "a", "w"])

    each = written(rows.select("tkey", "first", "s").mapInArrow(windows, "tkey binary, a int, w binary"), "windows")
    twice = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread_join(each, twice, ["w"], "n", ["tkey", "a"], each.count()).select("tkey", "a", (F.col("a") + LENGTH).alias("b"))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(tkey, spans): per text (known by its hash) the sorted byte spans to remove."""
    small_batches(docs.sparkSession)
    texts = docs.select(_key(F.coalesce(text, F.lit(""))).alias("tkey"), F.coalesce(text, F.lit("")).alias("_text")).where(F.octet_length("_text") >= LENGTH)
    every = written(texts.mapInArrow(_runs_of, RUN), "runs")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("x"), F.max("content").alias("y")).where("n > 1")
    anchors = anchors.select("anchor", (F.col("x") != F.col("y")).alias("mixed"), "n")
    shared = written(spread_join(every, anchors, ["anchor"], "n", ["tkey", "first"], every.count()).drop("n"), "shared")
    discard(every)
    kinds = shared.groupBy("anchor", "content", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tkey", "first", "windows", "off")).alias("one"))
    kinds = written(kinds, "kinds")
    repeats = spread_join(shared, kinds.where("n > 1").select("anchor", "content", "n"), ["anchor", "content"], "n", ["tkey", "first"], shared.count())
    whole = repeats.select("tkey", F.col("first").alias("a"), (F.col("first") + F.col("windows") - 1 + LENGTH).alias("b"))
    mixed = kinds.where("mixed").select("anchor", "one.*")
    crowd = written(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("anchor"), "crowd")
    wanted = written(mixed.groupBy("tkey").agg(F.collect_list(F.struct("anchor", "off", "first", "windows")).alias("wanted")), "wanted")
    small = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
    found = texts.join(small(wanted.select("tkey")), "tkey").groupBy("tkey").agg(F.first("_text").alias("_text"))
    strings = written(found.join(wanted, "tkey").select("tkey", "_text", "wanted").mapInArrow(_cut_runs, STRING), "strings")
    few = strings.join(crowd, "anchor", "left_anti")
    hits = whole.unionByName(few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_groups, FOUND))
    if not crowd.isEmpty():
        hits = hits.unionByName(_crowded(strings.join(crowd, "anchor", "left_semi")))
    spans = written(hits.groupBy("tkey").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    for done in (shared, kinds, crowd, wanted, strings):
        discard(done)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]))
        else:
            out.append((s["a"], s["b"]))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", content: bool = True) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 and, with ``content``, the bytes kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("tkey", _key(F.col("_text")))
    again = rows.groupBy("tkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spans = repeated_spans(docs, text).join(again, "tkey", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    joined = spread_join(rows, spans, ["tkey"], "n", ["doc"], docs.count(), "left").select("doc", "_text", "spans")
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = raw.encode()
                cut = merged(spans or [])
                kept = b"".join(data[a:b] for a, b in zip([0] + [b for _, b in cut], [a for a, _ in cut] + [len(data)]))
                rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * content]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * content)


def op6_suffix_groups(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), content=False).withColumnRenamed("doc", "doc_id")


OP6_SQL = """
WITH h AS MATERIALIZED (SELECT doc_id, coalesce(hex(text), '') x, (length(coalesce(hex(text), '')) // 2)::BIGINT n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) k FROM (SELECT doc_id, x, unnest(range(0, n - 199)) i FROM h WHERE n >= 200)),
f AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) no FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END new FROM f)),
s AS (SELECT doc_id, no, min(i) a, max(i) + 200 b FROM g GROUP BY doc_id, no),
p AS (SELECT s.doc_id, no, b - a gone, substr(x, 2 * coalesce(lag(b) OVER v, 0) + 1, 2 * (a - coalesce(lag(b) OVER v, 0))) || CASE WHEN lead(a) OVER v IS NULL THEN substr(x, 2 * b + 1) ELSE '' END piece
      FROM s JOIN h ON h.doc_id = s.doc_id WINDOW v AS (PARTITION BY s.doc_id ORDER BY no)),
r AS (SELECT doc_id, sum(gone) gone, count(*) spans, string_agg(piece, '' ORDER BY no) kept FROM p GROUP BY doc_id)
SELECT h.doc_id, h.n AS n_bytes, coalesce(r.gone, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(r.kept, h.x))) AS kept_sha256
FROM h LEFT JOIN r ON r.doc_id = h.doc_id
"""
