"""MinHash near-duplicates with an LSH forest of sorted signature orders.

A document's set holds its distinct 2-word shingles (words: runs outside ASCII white space, A-Z lowered;
a text of one word is its own shingle). Equal sets are collapsed first. Each of ``TREES`` orders sorts the
distinct sets by ``DEPTH`` MinHash values; in an order a set meets its next ``WINDOW`` neighbours, those of
the longest common prefix, as long as they share ``LEAST_DEPTH`` values. A crowded region is thereby entered
deeper than a sparse one. Runs longer than the window are contracted by component and sorted again until no
pass finds a link; then the rows outside a run's largest component are held against all of the run. Every link
is confirmed on the full sets, and components of links are the groups. A pair at the threshold shares no
region with probability (1 - 0.75^3)^24 = 0.000002.

Defined results: null and empty texts have empty sets and link with nothing; rows with equal sets are one
group however often they repeat; a null id takes part, and a group's id is its least id that is not null
(a row without id stays only where its whole group has none); long texts are used whole; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._links import BROADCAST_IDS, ORDER_ROW, candidates, settled
from ._spark import small_batches, spread_join, table, written

TREES, DEPTH, LEAST_DEPTH, WINDOW = 24, 6, 3, 10
#: Links need 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
#: Of the 48 one-byte values of a sketch, pairs with fewer in common aren't verified: at the threshold
#: 36 are expected, with a deviation of 3.
LEAST_SAME = 20

_seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, TREES * DEPTH), dtype=np.uint64)
_MULTIPLY, _ADD = _seeds[0] | np.uint64(1), _seeds[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Flat sorted distinct shingle hashes of all texts, and n + 1 offsets."""
    s, e, w = T.word_bounds(data, offsets)
    words = T.span_hashes(data, s, e)
    return sets_of(words, w, size)


def sets_of(words: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    grams, at = T.ngrams(words, w, size)
    cut = np.searchsorted(at, w)
    out = []
    for i in range(len(w) - 1):
        n = w[i + 1] - w[i]
        if n >= size:
            g = np.sort(grams[cut[i] : cut[i + 1]])
            out.append(g[np.r_[True, g[1:] != g[:-1]]])
        elif n:
            h = words[w[i]]
            for x in words[w[i] + 1 : w[i + 1]]:
                h = T.pair(np.array([h]), np.array([x]))[0]
            out.append(T.mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    lens = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.r_[0, np.cumsum(lens)].astype(np.int64)


def set_ids(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 63-bit identity of each set (0 for empty ones)."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(full):
        start = offsets[:-1][full]
        total = np.add.reduceat(T.mix(flat), start)
        other = np.bitwise_xor.reduceat(T.mix(flat + np.uint64(0x5851F42D4C957F2D)), start)
        out[full] = (T.mix(T.pair(total, other) + np.diff(offsets)[full].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return out


def minhashes(flat: np.ndarray, offsets: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One row per set, one mixed 64-bit minimum per hash function; empty sets have zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, len(multiply)), np.uint64)
    if len(full):
        start = offsets[:-1][full]
        for j, (a, b) in enumerate(zip(multiply, add)):
            out[full, j] = T.mix(np.minimum.reduceat((flat * a + b), start) ^ b)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a byte matrix."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(rows.tobytes())])


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of each set's little-endian hashes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tkey (hash of the text), n (set size), rid (identity of the set), sig (all orders' values) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in T.chunks(batch.column(1)):
                flat, cut = shingle_sets(data, offsets)
                sig = minhashes(flat, cut, _MULTIPLY, _ADD)
                lanes = (sig & np.uint64(0xFFFF)).astype(">u2")
                sketch = ((sig.reshape(-1, TREES, DEPTH)[:, :, :2] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).reshape(-1, 2 * TREES)
                cols = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(cut).astype(np.int32)), pa.array(set_ids(flat, cut)), binary(lanes.view(np.uint8).reshape(j - i, -1)), binary(sketch)]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "tkey", "n", "rid", "sig", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text, F.xxhash64(text).alias("tkey")).mapInArrow(run, "doc long, tkey long, n int, rid long, sig binary, sketch binary")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per set and order."""
    width = 2 * DEPTH
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(m, TREES, width)
        tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), m))
        again = pa.array(np.repeat(np.arange(m), TREES))
        yield pa.RecordBatch.from_arrays([tree, binary(sig.reshape(-1, width)), batch.column(0).take(again), batch.column(1).take(again), batch.column(3).take(again)], ["tree", "s", "rid", "n", "sketch"])


def reaches(xs: pa.Array, ys: pa.Array) -> list[bool]:
    """Whether the two sets of distinct hashes of each row are linked."""
    out = []
    for x, y in zip(xs.to_pylist(), ys.to_pylist()):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate([a, b]))
        same = int((both[1:] == both[:-1]).sum())
        out.append(100 * same >= PERCENT * (len(a) + len(b) - same))
    return out


def bodies_of(docs: DataFrame, sigs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(rid, body): the full set of each wanted identity, from one of its rows."""
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_IDS
    small = F.broadcast if few else (lambda x: x)
    #: Rows without an id are spread by the hash of their text; one that equals an id only fetches one text more.
    rows = sigs.select(F.coalesce("doc", "tkey").alias("_doc"), "rid").join(small(wanted), "rid")
    chosen = rows.groupBy("rid").agg(F.min("_doc").alias("_doc")).select("_doc").distinct()
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("_doc"), F.col(text).alias("_text")).join(small(chosen), "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                flat, cut = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(flat, cut)), lists(flat, cut)], ["rid", "body"])

    whole = texts.select("_text").mapInArrow(run, "rid long, body binary").join(small(wanted), "rid", "left_semi")
    return written(whole.groupBy("rid").agg(F.first("body").alias("body")), "bodies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tkey (hash of the text), n_shingles, component (least id of the group), group (its identity) and links.

    ``links`` are the verified links of the row's set.
    """
    small_batches(docs.sparkSession)
    sigs = written(signatures(docs, id_col, text), "signatures")
    reps = written(sigs.where("n > 0").groupBy("rid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies")), "sets")
    orders = reps.select("rid", "n", "sig", "sketch").mapInArrow(_orders, ORDER_ROW)
    shape = {"prefix": 2 * LEAST_DEPTH, "s_bytes": 2 * DEPTH, "sketch_bytes": 2 * TREES, "least_same": LEAST_SAME, "window": WINDOW, "ratio": PERCENT / 100}
    links, comp = settled(candidates(orders, **shape), lambda wanted: bodies_of(docs, sigs, wanted, id_col, text), reaches, shape)
    return _result(sigs, reps, comp, links)


def _result(sigs: DataFrame, reps: DataFrame, comp: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
    grouped = reps.select("rid", "doc", "copies").join(comp.withColumnRenamed("id", "rid"), "rid", "left").where("copies > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "rid"))
    least = grouped.groupBy("comp").agg(F.min("doc").alias("component")).join(grouped.select("comp", "rid", "copies"), "comp").join(ends, "rid", "left")
    least = least.select("rid", "comp", "component", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.lit(True).alias("hit"))
    rows = spread_join(sigs.select("doc", "tkey", "n", "rid"), least, ["rid"], "copies", ["doc", "tkey"], sigs.count(), "left")
    component = F.when(F.col("hit"), F.col("component")).otherwise(F.col("doc"))
    return rows.select("doc", "tkey", F.col("n").cast("long").alias("n_shingles"), component.alias("component"), F.coalesce("comp", "rid").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def op7_lsh_forest(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x id, x root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
c AS (SELECT id, min(root) m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""
