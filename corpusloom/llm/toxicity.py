"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its words (ASCII letters and digits, lower-cased, and anything beyond ASCII), hashed to
``BUCKETS`` binary features. The machine has a weight per feature and ``FACTORS`` latent factors, whose products are
the weights of pairs: an insult beside a group mention counts for more than both alone, which additive weights can't
express. All terms enter it: weights and factors are learned together by follow-the-regularized-leader, whose penalty
leaves at rest those whose gradients don't add up to more than chance would (a term that tells nothing alone moves
its factors all the same if its pairs do); what moved is then fitted again, without that penalty, by Adagrad. It
is fitted on at most ``SAMPLE`` labelled rows, those of the least hashed ids; rows with crc32(id) mod 5 = 0 are held
out. Only a text decides its score; the score is the logistic of the machine.

Defined results: null and empty texts have no terms and get the score of the bias; long texts are used
whole; equal texts have equal scores; null labels and null ids train nothing, and a null id isn't held
out; of rows that share an id and a label but not a text, the least term set trains; with no labelled rows, or of one
kind only, every score is the smoothed base rate; a column ``_toxicity`` of the input is replaced; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import small_batches, table

BUCKETS = 1 << 18
#: Most labelled rows the machine is fitted on, of about 2.5 kB each.
SAMPLE = 20_000
FACTORS, EPOCHS, BATCH = 8, 12, 64
RATE, DECAY = 0.1, 2e-4
#: Least updates, however few the rows.
UPDATES = 2000
#: Of the first fit: rate, spread of the factors at the start, epochs, and least updates, but in no more epochs than the last.
LEAD_RATE, LEAD_SPREAD, LEAD_EPOCHS, LEAD_UPDATES, LEAD_MOST = 0.05, 0.01, 3, 200, 25
#: A weight (factor) stays at rest while its gradients' sum is below the first (second) number and ``CHANCE`` times the
#: root of their squares' sum, times the root of the number of epochs.
REST, FACTOR_REST, CHANCE = 10.0, 5.0, 1.5


def term_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(flat distinct term buckets, n + 1 offsets) of runs of texts."""
    for i, j, data, offsets in T.chunks(column):
        s, e, w = T.word_bounds(data, offsets, T.ALNUM)
        terms = (T.span_hashes(data, s, e) % np.uint64(BUCKETS)).astype(np.int64)
        key = np.unique(np.repeat(np.arange(j - i), np.diff(w)) * BUCKETS + terms)
        yield key % BUCKETS, np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)


class Machine:
    def __init__(self, bias: float, slots: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.slots, self.weights, self.factors = bias, slots, weights, factors

    def raw(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The machine's value of each text."""
        f = self.slots[flat]
        keep = f >= 0
        cut = np.r_[0, np.cumsum(keep)][offsets]
        f = f[keep]
        out = self.bias + T.segment_sums(self.weights[f], cut)
        for k in range(self.factors.shape[1]):
            v = self.factors[f, k]
            out += 0.5 * (T.segment_sums(v, cut) ** 2 - T.segment_sums(v * v, cut))
        return out

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, offsets), -30, 30)))


def _batch(cut: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the features of given rows, the row of each, and the rows' edges among them."""
    n = cut[rows + 1] - cut[rows]
    edges = np.r_[0, np.cumsum(n)]
    return np.repeat(cut[rows] - edges[:-1], n) + np.arange(edges[-1]), np.repeat(np.arange(len(rows)), n), edges


def telling(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, seed: int = 1) -> np.ndarray:
    """Feature number of each bucket, -1 for those whose weight and factors never left their rest."""
    used, f = np.unique(flat, return_inverse=True)
    total, m, rng = len(y), len(used), np.random.default_rng(seed)
    prior = (y.sum() + 0.5) / (total + 1)
    bias, gb = float(np.log(prior / (1 - prior))), 1e-2
    start = rng.normal(0, LEAD_SPREAD, (m, FACTORS))
    w, v = np.zeros(m), start.copy()
    zw, qw, zv, qv = np.zeros(m), np.zeros(m), np.zeros((m, FACTORS)), np.zeros((m, FACTORS))

    def led(x, z, q, g, rest, chance):
        """Sums of gradients and of squares after g, and the distance from the start that they lead to."""
        z = z + g - (np.sqrt(q + g * g) - np.sqrt(q)) / LEAD_RATE * x
        q = q + g * g
        over = np.abs(z) - rest - chance * np.sqrt(q)
        return z, q, np.where(over > 0, -np.sign(z) * over / ((1 + np.sqrt(q)) / LEAD_RATE + 1e-3), 0.0)

    for epoch in range(max(LEAD_EPOCHS, min(LEAD_MOST, -(-LEAD_UPDATES * BATCH // total)))):
        order = rng.permutation(total)
        #: Each epoch repeats what chance did in the first.
        chance = CHANCE * np.sqrt(epoch + 1)
        for k in range(0, total, BATCH):
            rows = order[k : k + BATCH]
            at, own, edges = _batch(offsets, rows)
            feat = f[at]
            if not len(feat):
                continue
            held = v[feat]
            upto = np.zeros((len(feat) + 1, FACTORS))
            np.cumsum(held, axis=0, out=upto[1:])
            sums = upto[edges[1:]] - upto[edges[:-1]]
            value = bias + np.bincount(own, w[feat], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(own, (held**2).sum(1), len(rows)))
            g = 1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[rows]
            by = np.argsort(feat, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(feat[by]) > 0])
            t, own = feat[by][first], own[by]
            zw[t], qw[t], w[t] = led(w[t], zw[t], qw[t], np.add.reduceat(g[own], first), REST, chance)
            dv = np.add.reduceat(g[own, None] * (sums[own] - held[by]), first, axis=0)
            zv[t], qv[t], moved = led(v[t] - start[t], zv[t], qv[t], dv, FACTOR_REST, chance)
            v[t] = start[t] + moved
            gb += float(g.sum()) ** 2
            bias -= LEAD_RATE * float(g.sum()) / np.sqrt(gb)
    kept = used[(w != 0) | (v != start).any(1)]
    slots = np.full(BUCKETS, -1, np.int32)
    slots[kept] = np.arange(len(kept))
    return slots


def fit(flat: np.ndarray, offsets: np.ndarray, y: np.ndarray, seed: int = 1) -> Machine:
    """A machine fitted on texts' term sets and 0/1 labels."""
    total, pos = len(y), float(y.sum())
    prior = (pos + 0.5) / (total + 1)
    base = float(np.log(prior / (1 - prior)))
    if not 0 < pos < total:
        return Machine(base, np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    slots = telling(flat, offsets, y, seed)
    f = slots[flat]
    keep = f >= 0
    cut = np.r_[0, np.cumsum(keep)][offsets]
    f = f[keep]
    rng = np.random.default_rng(seed)
    m = int(slots.max()) + 1
    w, v, bias = np.zeros(m), rng.normal(0, 0.05, (m, FACTORS)), base
    gw, gv, gb = np.full(m, 1e-2), np.full((m, FACTORS), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // total))):
        order = rng.permutation(total)
        for k in range(0, total, BATCH):
            rows = order[k : k + BATCH]
            at, own, _ = _batch(cut, rows)
            feat = f[at]
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, own, v[feat])
            squares = np.bincount(own, (v[feat] ** 2).sum(1), len(rows))
            value = bias + np.bincount(own, w[feat], len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[rows]) / len(rows)
            touched, back = np.unique(feat, return_inverse=True)
            dw = np.bincount(back, g[own], len(touched)) + DECAY * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, back, g[own, None] * (sums[own] - v[feat]))
            dv += DECAY * v[touched]
            db = float(g.sum())
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += db**2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
            bias -= RATE * db / np.sqrt(gb)
    return Machine(float(bias), slots, w, v)


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of the bounded sample of labelled rows that aren't held out."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(SAMPLE)
    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(rows), "_id").select("_id", "_text", "_toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Machine:
    """Fits the machine in one task over the bounded sample, whatever order its rows come in."""
    small_batches(docs.sparkSession)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for flat, offsets in term_sets(batch.column(1)):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.ListArray.from_arrays(offsets.astype(np.int32), flat.astype(np.int32))], ["id", "toxic", "terms"])
                row += n

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, y, np.asarray(t, np.int64)) for b in batches for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False))]
        rows.sort(key=lambda r: (str(r[0]), r[1], r[2].tobytes()))
        flat = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])
        m = fit(flat, np.r_[0, np.cumsum([len(r[2]) for r in rows])].astype(np.int64), np.array([r[1] for r in rows], float))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.slots.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.factors.tobytes()])], ["bias", "slots", "weights", "factors"])

    #: Rows that repeat an id of the sample are folded before they meet in one task, so the bound holds.
    sample = training_rows(docs, labels, id_col, text).mapInArrow(terms, "id long, toxic int, terms array<int>").groupBy("id", "toxic").agg(F.min("terms").alias("terms"))
    model = sample.repartition(1).mapInArrow(learn, "bias double, slots binary, weights binary, factors binary").first()
    return Machine(model.bias, np.frombuffer(model.slots, np.int32), np.frombuffer(model.weights), np.frombuffer(model.factors).reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and, last, their score in a struct ``_toxicity`` (score, predicted)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def scores(column: pa.Array) -> pa.Array:
        """One batch's scores."""
        parts = [sent.value.score(flat, offsets) for flat, offsets in term_sets(column)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    value = F.arrow_udf(scores, "double")(F.col(text))
    return docs.withColumn("_toxicity", F.struct(value.alias("score"))).withColumn("_toxicity", F.struct(F.col("_toxicity.score").alias("score"), (F.col("_toxicity.score") >= 0.5).cast("int").alias("predicted")))


def op4_factorization_machine(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "_toxicity.score", "_toxicity.predicted")
