"""Linear text classification with models in the published fastText binary format.

The reader covers full and product-quantised matrices, word n-grams, character n-grams, and the softmax,
one-versus-all, negative-sampling and hierarchical outputs.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._files import resolve
from ._parts import in_parts
from ._regex import columns

MAGIC = 793712314
HS, NS, SOFTMAX, OVA = 1, 2, 3, 4
EOS = "</s>"


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out if len(out) > 1 else out[0]

    def text(self) -> str:
        end = self.raw.index(b"\0", self.at)
        out = self.raw[self.at : end].decode("utf-8", "surrogateescape")
        self.at = end + 1
        return out

    def array(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out


def _dense(r: _Reader) -> np.ndarray:
    m, n = r.take("qq")
    return r.array("<f4", m * n).reshape(m, n)


def _codebook(r: _Reader):
    dim, parts, width, last = r.take("iiii")
    return dim, parts, width, last, r.array("<f4", dim * 256)


def _lookup(codes: np.ndarray, book) -> np.ndarray:
    """Rows of a product-quantised matrix."""
    dim, parts, width, last, centroids = book
    out = np.empty((len(codes), dim), np.float32)
    for p in range(parts):
        w = last if p == parts - 1 else width
        base = p * 256 * width + codes[:, p].astype(np.int64) * w
        out[:, p * width : p * width + w] = centroids[base[:, None] + np.arange(w)]
    return out


def _quantised(r: _Reader) -> np.ndarray:
    norms = r.take("?")
    m, _ = r.take("qq")
    size = r.take("i")
    codes = r.array(np.uint8, size)
    rows = _lookup(codes.reshape(m, -1), _codebook(r))
    if norms:
        own = r.array(np.uint8, m)
        rows = rows * _lookup(own.reshape(m, 1), _codebook(r))
    return rows


def fnv(raw: bytes) -> int:
    """32-bit FNV-1a over signed bytes."""
    h = 2166136261
    for c in raw:
        h = ((h ^ (c | 0xFFFFFF00 if c > 127 else c)) * 16777619) & 0xFFFFFFFF
    return h


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            r = _Reader(f.read())
        magic, version = r.take("ii")
        if magic != MAGIC or version > 12:
            raise ValueError(f"not a model of a known format: {path}")
        self.dim, _, _, _, _, self.word_ngrams, self.loss, kind, self.bucket, self.minn, self.maxn, _ = r.take("12i")
        r.take("d")
        if kind != 3:
            raise ValueError("only classification models have labels")
        if version == 11:
            self.maxn = 0
        size, self.n_words, n_labels = r.take("iii")
        _, pruned = r.take("qq")
        self.words: dict[str, int] = {}
        self.labels: list[str] = []
        counts = []
        for i in range(size):
            word = r.text()
            count, what = r.take("qb")
            if what:
                self.labels.append(word)
                counts.append(count)
            else:
                self.words[word] = i
        self.prune = dict(r.take("ii") for _ in range(pruned)) if pruned > 0 else None
        self.pruned = pruned
        self.input = _quantised(r) if (quantised := r.take("?")) else _dense(r)
        out_quantised = r.take("?")
        self.output = _quantised(r) if quantised and out_quantised else _dense(r)
        if self.loss == HS:
            self.paths = _tree(counts)

    def _hashed(self, h: int) -> list[int]:
        if self.pruned == 0 or self.bucket <= 0:
            return []
        if self.prune is not None:
            return [self.n_words + self.prune[h]] if h in self.prune else []
        return [self.n_words + h]

    def _subwords(self, word: str) -> list[int]:
        raw, out = ("<" + word + ">").encode("utf-8", "surrogateescape"), []
        for i in range(len(raw)):
            if raw[i] & 0xC0 == 0x80:
                continue
            j = i
            for n in range(1, self.maxn + 1):
                if j >= len(raw):
                    break
                j += 1
                while j < len(raw) and raw[j] & 0xC0 == 0x80:
                    j += 1
                if n >= self.minn and not (n == 1 and (i == 0 or j == len(raw))):
                    out += self._hashed(fnv(raw[i:j]) % self.bucket)
        return out

    def features(self, text: str, eos: bool = True) -> list[int]:
        """Input rows of one line of text."""
        words = [w for w in re.split(r"[ \n\r\t\v\f\0]+", text) if w] + [EOS] * eos
        out, hashes = [], []
        for w in words:
            own = self.words.get(w)
            if own is not None:
                out.append(own)
            if w != EOS and self.maxn > 0:
                out += self._subwords(w)
            h = fnv(w.encode("utf-8", "surrogateescape"))
            hashes.append(h - 2**32 if h >= 2**31 else h)
        for i in range(len(hashes) if self.word_ngrams > 1 else 0):
            h = hashes[i] & (2**64 - 1)
            for j in range(i + 1, min(len(hashes), i + self.word_ngrams)):
                h = (h * 116049371 + hashes[j]) & (2**64 - 1)
                out += self._hashed(h % self.bucket)
        return out

    def predict(self, text: str, eos: bool = True) -> list[tuple[str, float]]:
        """All labels with their probabilities, best first; nothing for a text without features."""
        rows = self.features(text, eos)
        if not rows or not self.labels:
            return []
        hidden = self.input[rows].mean(axis=0, dtype=np.float32)
        z = (self.output @ hidden).astype(np.float64)
        if self.loss == SOFTMAX:
            p = np.exp(z - z.max())
            p /= p.sum()
        else:
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            if self.loss == HS:
                p = np.array([np.prod([p[n] if right else 1 - p[n] for n, right in path]) for path in self.paths])
        #: The format's reference adds 1e-5 before it takes logarithms.
        p = p + 1e-5
        order = np.argsort(-p, kind="stable")
        return [(self.labels[i], float(p[i])) for i in order]


def _tree(counts: list[int]) -> list[list[tuple[int, bool]]]:
    """Inner nodes and turns from each label to the root of the Huffman tree of the label counts."""
    n = len(counts)
    count = [*counts, *[10**15] * (n - 1)]
    parent, right = [-1] * (2 * n - 1), [False] * (2 * n - 1)
    leaf, node = n - 1, n
    for i in range(n, 2 * n - 1):
        two = []
        for _ in range(2):
            if leaf >= 0 and count[leaf] < count[node]:
                two.append(leaf)
                leaf -= 1
            else:
                two.append(node)
                node += 1
        count[i] = count[two[0]] + count[two[1]]
        parent[two[0]] = parent[two[1]] = i
        right[two[1]] = True
    paths = []
    for i in range(n):
        path, j = [], i
        while parent[j] >= 0:
            path.append((parent[j] - n, right[j]))
            j = parent[j]
        paths.append(path)
    return paths


@lru_cache(maxsize=4)
def _load(path: str, changed: float) -> Model:
    return Model(path)


def model(path: str) -> Model:
    """A worker keeps its models until their files change."""
    path = resolve(path)
    return _load(path, os.path.getmtime(path))


def folded(predictions: Sequence[tuple[str, float]], labels: Sequence[str]) -> tuple[str, float, float, list[float]]:
    """Best of the wanted labels (the first of equals), its score, their total, and each one's score."""
    got = dict(predictions)
    scores = [got.get(label, 0.0) for label in labels]
    top, best = labels[0], 0.0
    for label, p in predictions:
        if label in labels and p > best:
            top, best = label, p
    return top, best, sum(scores), scores


def fasttext(expr: Column | str, *, path: str, labels: Sequence[str], output_scores: bool = False, output_aggregate: bool = True, add_eos: bool = True) -> Column:
    """A struct of top_label, top_score and total_score over ``labels`` and, if asked, a score per label.

    White-space runs count as one space. Null text gives null fields. ``path`` is one that all executors see, or a file sent to them with ``ship_file``.
    """
    wanted = list(labels)
    if not wanted or len(set(wanted)) != len(wanted):
        raise ValueError("labels must be given, each once")
    if not output_aggregate and not output_scores:
        raise ValueError("at least one of output_aggregate and output_scores must be on")
    fields = [("top_label", pa.string(), "string"), ("top_score", pa.float32(), "float"), ("total_score", pa.float32(), "float")] if output_aggregate else []
    if output_scores:
        fields += [(label, pa.float32(), "float") for label in wanted]

    def classify(text: pa.Array) -> pa.Array:
        own, rows = model(path), []
        for t in text.to_pylist():
            if t is None:
                rows.append([None] * len(fields))
                continue
            top, best, total, scores = folded(own.predict(re.sub(r"\s+", " ", t), add_eos), wanted)
            rows.append(([top, best, total] if output_aggregate else []) + (scores if output_scores else []))
        cols = list(zip(*rows)) if rows else [[]] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(cols, fields)], [name for name, _, _ in fields])

    schema = ",".join(f"`{name}`:{kind}" for name, _, kind in fields)
    return F.arrow_udf(in_parts(classify), f"struct<{schema}>")(columns(expr))
