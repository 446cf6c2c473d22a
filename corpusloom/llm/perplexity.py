"""Quality rules from word and line counts and from n-gram perplexity.

The language model is a modified Kneser-Ney model over bytes (A-Z lowered, white space one kind), one per
value of the language column, of order ``ORDER``. Spark counts the longest n-grams of all documents and
derives the continuation counts, discounts, probabilities and backoff weights. A text must not vouch for
itself: n-grams of order 3 and more that one text alone holds (copies of it included) are left out of the
model, and their mass goes to the backoff. Each order is stored as one table sorted by key; a worker reads the
languages it meets into sorted arrays and finds n-grams by binary search.

A document's value is its log-perplexity per byte. Values spread the less the longer texts are: per language
the squared quartile distance is fitted, over all documents by classes of length, as a + b / bytes. A document
is rejected below ``LOW`` or above ``HIGH`` deviations of its length from its language's median, and where the
word rules reject it. Below lie texts of few, over-frequent strings, above garbled ones and other languages.

Defined results: null and empty texts have no words, fail the rules and have a null perplexity; a null
language is a language of its own; long texts are used whole; rows are scored one by one, so repeated rows
repeat (and count in the model as often as they occur); an empty table gives no rows. Languages are known by
23-bit hashes of their names: of n languages two share a model with probability n^2 / 2^24.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import discard, small_batches, spread_join, table, written

ORDER = 5
#: The bands' half-widths in deviations, and the quartile distance of a deviation.
LOW, HIGH, QUARTILES = 3.0, 4.5, 1.349
#: Steps of log-perplexity in which quartiles are found.
STEPS = 2000
#: Bytes about which spreads level out, for the weights of length classes.
LEVEL = 4000
#: Languages whose model a worker holds at once.
LOADED = 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
MASK = [(1 << 8 * k) - 1 for k in range(ORDER + 1)]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated 5-word windows."""
    n = len(offsets) - 1
    s, e, w = T.word_bounds(data, offsets)
    chars = T.segment_sums(T.SPACED[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = T.segment_sums(_SYMBOL[data], offsets)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    #: A text's end is the next one's start: a line ends at a break of its own or at an end beyond its start.
    ends = np.minimum(np.r_[breaks, len(data)][np.searchsorted(breaks, starts)], offsets[np.searchsorted(offsets, starts, "right")])
    wordy = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends = starts[wordy], ends[wordy]
    doc = np.searchsorted(offsets, starts, "right") - 1
    lines = np.bincount(doc, minlength=n)
    key = T.pair(T.span_hashes(data, starts, ends, fold=False), doc.astype(np.uint64))
    _, one = np.unique(key, return_index=True)
    dup_lines = lines - np.bincount(doc[one], minlength=n)
    grams, at = T.ngrams(T.span_hashes(data, s, e, fold=False), w, 5)
    owner = np.searchsorted(w, at, "right") - 1
    _, back, many = np.unique(T.pair(grams, owner.astype(np.uint64)), return_inverse=True, return_counts=True)
    hit = at[many[back] > 1]
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    repeat = T.segment_sums(np.cumsum(cover)[:-1] > 0, w)
    return np.diff(w), chars, symbols, dup_lines, repeat


def language_key(lang: str | None) -> int:
    """A 23-bit number of a language."""
    data = np.frombuffer(("-" if lang is None else "+" + lang).encode(), np.uint8)
    return int(T.span_hashes(data, np.array([0]), np.array([len(data)]), fold=False)[0] >> np.uint64(41))


def codes(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The language and ``ORDER`` bytes ending at each byte, texts preceded by spaces."""
    n = len(data)
    folded = _FOLD[data]
    out = np.repeat(langs.astype(np.uint64), np.diff(offsets))
    room = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(ORDER - 1, -1, -1):
        b = np.full(n, 32, np.uint8)
        b[k:] = folded[: n - k]
        if k:
            b[room < k] = 32
        out = (out << np.uint64(8)) | b
    return out


def _langs(column: pa.Array) -> np.ndarray:
    names = column.dictionary_encode()
    keys = np.array([language_key(x) for x in names.dictionary.to_pylist()] + [language_key(None)], np.int64)
    return keys[names.indices.fill_null(len(keys) - 1).to_numpy(zero_copy_only=False).astype(np.int64)]


def _summed(keys: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal keys as one: counts added, least and greatest text."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(f.reduceat(x[order], first) if len(first) else x for f, x in ((np.add, c), (np.minimum, lo), (np.maximum, hi)))


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, g, c, lo, hi): how often each n-gram of the highest order occurs, and the least and greatest hash of the texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            langs, names = _langs(batch.column(1)), batch.column(2).fill_null(0).to_numpy()
            for i, j, data, offsets in T.chunks(batch.column(0)):
                code = codes(data, offsets, langs[i:j])
                each = [np.unique(code[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:])]
                own = np.repeat(names[i:j], [len(k) for k, _ in each]).astype(np.int32)
                held.append(_summed(np.concatenate([k for k, _ in each]), np.concatenate([c for _, c in each]), own, own))
                if sum(len(x[0]) for x in held) > 6_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 3_000_000:
                        yield from parts(*held.pop())
        if held:
            yield from parts(*merged())

    def parts(keys: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 100_000):
            x = keys[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((x >> np.uint64(8 * ORDER)).astype(np.int64)), pa.array((x & np.uint64(MASK[ORDER])).astype(np.int64)), *(pa.array(r[k : k + 100_000]) for r in rest)], ["lang", "g", "c", "lo", "hi"])

    rows = docs.select(text, lang, F.shiftright(F.xxhash64(text), 32).cast("int").alias("name"))
    return rows.mapInArrow(run, "lang long, g long, c long, lo int, hi int").groupBy("lang", "g").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _discount(n: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from the counts of counts."""
    ones = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = F.least("n1", "n2", "n3", "n4") > 0

    def d(k: int) -> Column:
        return F.when(whole, F.greatest(F.lit(0.1), F.least(F.lit(float(k)) - 0.05, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(k * 0.6)).alias(f"d{k}")

    return n.groupBy("lang").agg(*ones, F.count(F.lit(1)).alias("grams")).select("lang", d(1), d(2), d(3), "grams")


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[str]:
    """Paths of the model's tables, lowest order first: key, value (log p) and backoff (log weight)."""
    small_batches(docs.sparkSession)
    counts = {ORDER: written(count_grams(docs, text, lang), "grams")}
    for k in range(ORDER - 1, 0, -1):
        shorter = counts[k + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(MASK[k])).alias("g")).agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        counts[k] = written(shorter, "grams")
    paths, below, model = [], None, {}
    for k in range(1, ORDER + 1):
        t = spread_join(counts[k], _discount(counts[k]), ["lang"], "grams", ["g"], counts[k].count())
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        keep = (F.col("lo") < F.col("hi")) | F.lit(k < 3)
        t = t.select("lang", "g", "c", F.shiftright("g", 8).alias("ctx"), keep.alias("keep"), (F.col("c") - off).alias("left"))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("s"), F.sum(F.when(F.col("keep"), F.col("left")).otherwise(0.0)).alias("m")).withColumn("gamma", F.greatest(1 - F.col("m") / F.col("s"), F.lit(1e-9)))
        rows = t.where("keep").join(ctx, ["lang", "ctx"])
        if below is None:
            rows = rows.withColumn("q", F.lit(1 / 256))
        else:
            rows = rows.withColumn("tail", F.col("g").bitwiseAND(F.lit(MASK[k - 1]))).join(below.select("lang", F.col("g").alias("tail"), F.col("p").alias("q")), ["lang", "tail"])
        below = written(rows.select("lang", "g", (F.col("left") / F.col("s") + F.col("gamma") * F.col("q")).alias("p")), "model")
        model[k] = (below, ctx)
    for k in range(1, ORDER + 1):
        own = model[k][0]
        if k < ORDER:
            after = model[k + 1][1].select("lang", F.col("ctx").alias("g"), F.log("gamma").alias("backoff"))
            #: Contexts that only start texts are no n-grams of their own: they have a weight and no value.
            own = own.join(after, ["lang", "g"], "full")
        else:
            own = own.withColumn("backoff", F.lit(0.0))
        key = F.shiftleft("lang", 8 * ORDER).bitwiseOR(F.col("g")).alias("key")
        out = written(own.select(key, F.coalesce(F.log("p"), F.lit(float("nan"))).cast("float").alias("value"), F.coalesce("backoff", F.lit(0.0)).cast("float").alias("backoff")).orderBy("key"), f"order{k}")
        paths.append(out._corpusloom_path)
    bare = model[1][1].select(F.shiftleft("lang", 8 * ORDER).alias("key"), F.log("gamma").cast("float").alias("value"), F.lit(0.0).cast("float").alias("backoff"))
    paths.insert(0, written(bare.orderBy("key"), "order0")._corpusloom_path)
    for done in [*counts.values(), *(t for t, _ in model.values())]:
        discard(done)
    return paths


@lru_cache(maxsize=LOADED)
def load(paths: tuple[str, ...], lang: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted keys, values and backoffs of each order of a language, once per worker."""
    import pyarrow.fs as pafs

    first = lang << 8 * ORDER
    out = []
    for p in paths:
        fs, root = pafs.FileSystem.from_uri(p)
        t = pq.read_table(root, filesystem=fs, filters=[("key", ">=", first), ("key", "<=", first | MASK[ORDER])])
        key, value, backoff = (t.column(c).to_numpy() for c in ("key", "value", "backoff"))
        order = np.argsort(key, kind="stable")
        out.append((key[order].astype(np.uint64), value[order], backoff[order]))
    return out


def log_probabilities(model: list, code: np.ndarray) -> np.ndarray:
    """log p of the last byte of each code given those before."""
    lang = (code >> np.uint64(8 * ORDER)) << np.uint64(8 * ORDER)
    out = np.zeros(len(code))
    todo = np.arange(len(code))
    for k in range(ORDER, 0, -1):
        keys, value, _ = model[k]
        own = (lang | (code & np.uint64(MASK[k])))[todo]
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        hit = (keys[at] == own) & ~np.isnan(value[at]) if len(keys) else np.zeros(len(own), bool)
        out[todo[hit]] += value[at[hit]]
        todo = todo[~hit]
        if not len(todo):
            return out
        if k > 1:
            keys, _, backoff = model[k - 1]
            ctx = (lang | ((code >> np.uint64(8)) & np.uint64(MASK[k - 1])))[todo]
            at = np.minimum(np.searchsorted(keys, ctx), max(len(keys) - 1, 0))
            if len(keys):
                out[todo] += np.where(keys[at] == ctx, backoff[at], 0.0)
    keys, value, _ = model[0]
    at = np.minimum(np.searchsorted(keys, lang[todo]), max(len(keys) - 1, 0))
    known = keys[at] == lang[todo] if len(keys) else np.zeros(len(todo), bool)
    out[todo] += np.log(1 / 256) + (np.where(known, value[at], 0.0) if len(keys) else 0.0)
    return out


def signals(docs: DataFrame, paths: list[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: id, lang, n_bytes, the base counts and log_perplexity (null without text)."""
    names = ["doc", "lang", "n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _langs(batch.column(2))
            for i, j, data, offsets in T.chunks(batch.column(1)):
                base = base_counts(data, offsets)
                code, back = np.unique(codes(data, offsets, langs[i:j]), return_inverse=True)
                own = (code >> np.uint64(8 * ORDER)).astype(np.int64)
                value = np.zeros(len(code))
                for x in np.unique(own):
                    value[own == x] = log_probabilities(load(tuple(paths), int(x)), code[own == x])
                total = T.segment_sums(value[back], offsets)
                n = np.diff(offsets)
                value = pa.array(-total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), *(pa.array(x.astype(np.int64)) for x in base), value], names)

    return docs.select(F.col(id_col).cast("long").alias("doc"), text, lang).mapInArrow(run, "doc long, lang string, n_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double")


def bands(scored: DataFrame) -> DataFrame:
    """(lang, mid, a, b, rows): median of log-perplexity, and its squared quartile distance as a + b / bytes, from all documents.

    Quartiles are found in steps of 1 / ``STEPS``, per class of lengths (powers of two); the line is that of
    least squares over the classes, each as weighty as its rows and in relation to 1 / bytes + 1 / ``LEVEL``, with
    a and b not below 0.
    """
    cls = F.floor(F.log2("n_bytes"))
    bins = scored.where("log_perplexity IS NOT NULL").groupBy("lang", cls.alias("cls"), F.floor(F.col("log_perplexity") * STEPS).alias("bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("n_bytes")).alias("x"))

    def quantiles(rows: DataFrame, keys: list[str], **at: float) -> DataFrame:
        upto = rows.withColumns({"upto": F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")), "total": F.sum("n").over(Window.partitionBy(*keys))})
        found = [F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) / STEPS)).alias(name) for name, q in at.items()]
        return upto.groupBy(*keys).agg(*found, F.max("total").alias("rows"), F.sum("x").alias("x"))

    whole = quantiles(bins.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), ["lang"], mid=0.5)
    each = quantiles(bins, ["lang", "cls"], low=0.25, high=0.75).select("lang", (F.col("x") / F.col("rows")).alias("x"), F.pow(F.greatest(F.col("high") - F.col("low"), F.lit(1 / STEPS)), 2).alias("y"), "rows")
    w = F.col("rows") / F.pow(F.col("x") + 1 / LEVEL, 2)
    total = lambda c, name: F.sum(w * c).alias(name)
    x, y = F.col("x"), F.col("y")
    fit = each.groupBy("lang").agg(F.sum(w).alias("s"), total(x, "sx"), total(y, "sy"), total(x * x, "sxx"), total(x * y, "sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    b = F.when(det > 1e-9 * F.col("s") * F.col("sxx"), (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(0.0)
    fit = fit.withColumn("b", F.greatest(b, F.lit(0.0))).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("s"))
    fit = fit.withColumn("b", F.when(F.col("a") < 0, F.col("sxy") / F.col("sxx")).otherwise(F.col("b"))).withColumn("a", F.greatest("a", F.lit(0.0)))
    return whole.select("lang", "mid", "rows").join(fit.select(F.col("lang").alias("_l"), "a", "b"), F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")


def judged(scored: DataFrame) -> DataFrame:
    """Adds base_failed, kept, and the row's band."""
    named = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-"))
    b = written(bands(scored).withColumn("_lang", named).drop("lang"), "bands")
    rows = spread_join(scored.withColumn("_lang", named), b, ["_lang"], "rows", ["doc", "n_words", "n_bytes"], scored.count(), "left")
    wide = F.sqrt(F.col("a") + F.col("b") / F.greatest(F.col("n_bytes"), F.lit(1))) / QUARTILES
    lower, upper = F.col("mid") - LOW * wide, F.col("mid") + HIGH * wide
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(lower, upper), F.lit(False))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & inside, "lower": lower, "upper": upper}).drop("_lang", "mid", "a", "b", "rows")


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = written(signals(docs, train(docs)), "perplexity")
    return judged(scored).select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")
