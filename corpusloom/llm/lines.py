"""Line deduplication over overlapping windows of consecutive lines.

Lines are the pieces of a text between newlines; blank ones (nothing but spaces, tabs and carriage
returns) belong to no window but go with the span that covers them. Each run of ``window`` further lines,
compared without outer blanks, is hashed (128 bits). The first occurrence by (document id, line) of each
repeated window stays, all others are removed: the lines covered by any of them go, spans merged.

Defined results: a null text stays null with no lines; an empty text has one blank line and stays; texts
with fewer lines than a window are never changed; rows of one id and text count as one document, so neither
holds repeats of the other; rows of one id (or none, which comes last) and different texts are ordered by a
hash of the text; an empty table gives no rows. Other columns pass through unread, whatever their names, but for
``_lines``, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches, spread_join, table, written

WINDOW = 3


def line_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: key (128-bit hash), doc, tkey (hash of the text), and its first and last line number."""
    if window < 1:
        raise ValueError("window must be at least 1")
    lines = docs.select(
        F.coalesce(F.col(id_col), F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64(text).alias("tkey"),
        F.expr(f"filter(transform(split(`{text}`, '\\n', -1), (x, i) -> struct(btrim(x, ' \\t\\r') AS t, i AS p)), s -> s.t != '')").alias("ls"),
    ).where(F.size("ls") >= window)
    texts = ", ".join(f"ls[k + {j}].t" for j in range(window))
    each = f"transform(sequence(0, size(ls) - {window}), k -> struct(unhex(md5(concat_ws('\\n', {texts}))) AS key, ls[k].p AS a, ls[k + {window - 1}].p AS b))"
    return lines.select("doc", "tkey", F.explode(F.expr(each)).alias("w")).select("w.key", "doc", "tkey", "w.a", "w.b")


def later_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with repeats: doc, tkey, and the line spans of every later occurrence."""
    rows = written(line_windows(docs, window, id_col, text), "windows")
    repeats = rows.groupBy("key").agg(F.min(F.struct("doc", "tkey", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = spread_join(rows, repeats, ["key"], "n", ["doc", "tkey", "a"], rows.count())
    later = joined.where((F.col("doc") != F.col("first.doc")) | (F.col("tkey") != F.col("first.tkey")) | (F.col("a") != F.col("first.a")))
    return later.groupBy("doc", "tkey").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _without(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    kept, gone = [], []
    for t, a, b in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        if t is None:
            kept.append(None)
            gone.append(0)
            continue
        lines = t.split("\n")
        depth = np.zeros(len(lines) + 1, np.int64)
        np.add.at(depth, np.minimum(np.array(a), len(lines)), 1)
        np.add.at(depth, np.minimum(np.array(b) + 1, len(lines)), -1)
        covered = np.cumsum(depth)[:-1] > 0
        kept.append("\n".join([x for x, c in zip(lines, covered.tolist()) if not c]))
        gone.append(int(covered.sum()))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, pa.int64())], ["text", "n"])


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with repeated windows removed, then ``n_lines`` and ``n_removed`` in a struct ``_lines``."""
    small_batches(docs.sparkSession)
    spans = later_spans(docs, window, id_col, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(id_col), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    joined = rows.join(spans, ["doc", "tkey"], "left")
    without = F.arrow_udf(_without, "struct<text: string, n: long>")
    cut = without(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans.a"), F.col("spans.b"))
    counts = F.struct(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("cut.n", F.lit(0)).cast("long").alias("n_removed")).alias("_lines")
    kept = [(F.coalesce("cut.text", "text") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns if c != "_lines"]
    return joined.withColumn("cut", cut).select(*kept, counts)


def op3_line_windows(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


OP3_SQL = r"""
WITH arr AS (SELECT doc_id, text, string_split(text, chr(10)) xs FROM documents),
l AS (SELECT doc_id, unnest(xs) x, unnest(range(len(xs))) p FROM arr),
t AS (SELECT doc_id, p, trim(x, ' ' || chr(9) || chr(13)) t FROM l),
w AS (SELECT doc_id, p a, lead(p, 2) OVER v b, t || chr(10) || lead(t, 1) OVER v || chr(10) || lead(t, 2) OVER v k
      FROM t WHERE t <> '' WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
o AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) rn FROM w WHERE b IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) p FROM o WHERE rn > 1),
kept AS (SELECT l.doc_id, count(*) n, count(gone.p) g,
                coalesce(string_agg(x, chr(10) ORDER BY l.p) FILTER (WHERE gone.p IS NULL), '') text
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id)
SELECT arr.doc_id, coalesce(n, 0)::BIGINT n_lines, coalesce(g, 0)::BIGINT n_removed,
       CASE WHEN arr.text IS NULL THEN NULL ELSE kept.text END text
FROM arr LEFT JOIN kept USING (doc_id)
"""
