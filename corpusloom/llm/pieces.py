"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Distinct segments of a batch become one flat array of symbols. Each round finds, per segment, the least
merge rank of its adjacent pairs, merges all leftmost non-overlapping pairs of that rank at once, and
compacts; a segment leaves when none of its pairs can merge. Where a merge could make a pair of better
rank than its own, only the leftmost is merged, so the result is that of the sequential algorithm.

Defined results: null text encodes as empty text; empty text has only the end id and decodes to empty
text; texts are never cut; rows are independent, so repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import small_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct segments a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Characters of text encoded together.
CHUNK_CHARS = 2_000_000
_NONE = np.int64(1 << 40)


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            b = buf[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, i
            shift += 7

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
            yield tag >> 3, value
        elif kind == 2:
            n, i = varint(i)
            yield tag >> 3, buf[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, buf[i : i + n]
            i += n


class PieceModel:
    """A BPE model with byte fallback, read from its published binary format."""

    def __init__(self, path: str):
        pieces, scores, kinds = [], [], []
        trainer: dict = {}
        normal: dict = {}
        with open(path, "rb") as f:
            for no, value in _fields(f.read()):
                if no == 1:
                    x = dict(_fields(value))
                    pieces.append(x.get(1, b"").decode("utf-8"))
                    scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                    kinds.append(x.get(3, NORMAL))
                elif no == 2:
                    trainer = dict(_fields(value))
                elif no == 3:
                    normal = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback are supported")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that keep white space and characters as they are are supported")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces, self.kinds = pieces, np.array(kinds)
        self.prefix = bool(normal.get(3, 1))
        self.unknown = kinds.index(UNKNOWN)
        self.end = pieces.index("</s>") if "</s>" in pieces else trainer.get(42, 2)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self._index(scores)
        self.surface = [self._surface(i) for i in range(len(pieces))]
        self.controls = [i for i, k in enumerate(kinds) if k == CONTROL]
        self.decimal = [str(i) for i in range(len(pieces))]

    def _index(self, scores: list[float]) -> None:
        """Symbols, merges in sorted key order, their ranks, and where pieces forbid a cut."""
        own = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        symbols = dict(own)
        for p in own:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.size = len(self.pieces) + len(symbols) + 1
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in own.values()}, reverse=True))}
        rank = np.full(self.size, _NONE)
        for p, i in own.items():
            rank[i] = order[scores[i]]
        tied = np.bincount(rank[rank < _NONE], minlength=1) > 1
        self.lone = np.zeros(self.size, bool)
        self.lone[: len(rank)][rank < _NONE] = tied[rank[rank < _NONE]]
        keys, merged, joins = [], [], set()
        middle = newline = False
        for p, i in own.items():
            middle |= SPACE in p.lstrip(SPACE)
            newline |= "\n" in p and len(p) > 1
            joins.update(p[k : k + 2] for k in range(len(p) - 1))
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(i)
                    for x in (a, b):
                        if rank[i] <= rank[x] < _NONE:
                            self.lone[x] = True
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[at], np.array(merged, np.int64)[at]
        self.ranks = rank[self.merged]
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.joins = np.sort(np.array([(ord(j[0]) << 21) | ord(j[1]) for j in joins] or [-1], np.int64))
        cut = "" if newline else "\\n"
        self.segment = re.compile(r"[\s\S]+" if middle else f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+|\\n")

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == UNKNOWN:
            return " ⁇ ".encode()
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return self.pieces[i].replace(SPACE, " ").encode()

    def escaped(self, text: str) -> str:
        """The text as the model sees it: white space marked, one mark before a non-empty text."""
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def merge_rounds(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments, and n + 1 offsets of each one's."""
        counts = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(segments)), counts)
        sym = self.of_char[chars].astype(np.int64)
        #: Unknown characters keep their code point for the byte fallback.
        sym[sym < 0] = -1 - chars[sym < 0]
        pairs = (chars[:-1] << 21) | chars[1:]
        known = self.joins[np.minimum(np.searchsorted(self.joins, pairs), len(self.joins) - 1)] == pairs
        starts = np.ones(len(sym), bool)
        starts[1:] = (owner[1:] != owner[:-1]) | ~known
        part = np.cumsum(starts) - 1
        place = np.arange(len(sym))
        done_place, done_sym = [], []
        while len(sym):
            n = len(sym)
            key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0) & (part[:-1] == part[1:]), sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(n, _NONE)
            rank[:-1] = np.where(self.keys[at] == key, self.ranks[at], _NONE)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            lens = np.diff(np.r_[first, n])
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < _NONE, lens)
            if not live.all():
                done_place.append(place[~live])
                done_sym.append(sym[~live])
                at = np.r_[at, 0][live]
                rank, sym, part, place = rank[live], sym[live], part[live], place[live]
                least, lens = least[least < _NONE], lens[least < _NONE]
                if not len(sym):
                    break
            else:
                at = np.r_[at, 0]
            hit = rank == np.repeat(least, lens)
            where = np.flatnonzero(hit)
            run = np.r_[True, np.diff(where) > 1]
            head = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            take = where[(np.arange(len(where)) - head) % 2 == 0]
            new = self.merged[at[take]]
            leads = np.r_[True, part[take][1:] != part[take][:-1]]
            ok = leads | ~self.lone[new]
            #: After a lone merge its segment waits for the next round.
            lead_lone = np.repeat(self.lone[new[leads]], np.diff(np.r_[np.flatnonzero(leads), len(take)]))
            ok &= leads | ~lead_lone
            take, new = take[ok], new[ok]
            sym[take] = new
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, part, place = sym[keep], part[keep], place[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(segments) + 1, np.int64)
        place, sym = np.concatenate(done_place), np.concatenate(done_sym)
        order = np.argsort(place)
        sym, seg = sym[order], owner[place[order]]
        sym, seg = self._fall_back(sym, seg)
        return sym.astype(np.int32), np.searchsorted(seg, np.arange(len(segments) + 1))

    def _fall_back(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the ids of their bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        if not len(odd):
            return sym, seg
        back = {int(v): k for k, v in enumerate(self.of_char) if v >= len(self.pieces)} if (sym >= len(self.pieces)).any() else {}
        code = [(-1 - int(s)) if s < 0 else back[int(s)] for s in sym[odd]]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in code]
        n = np.ones(len(sym), np.int64)
        n[odd] = [len(r) for r in raw]
        out, to = np.repeat(sym, n), np.cumsum(n) - n
        flat = np.frombuffer(b"".join(raw), np.uint8)
        spots = np.repeat(to[odd], n[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
        out[spots] = self.byte_ids[flat]
        return out, np.repeat(seg, n)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: control pieces vanish, one leading white-space mark goes, bad bytes become U+FFFD."""
        lead = 0
        while lead < len(ids) and self.kinds[ids[lead]] == CONTROL:
            lead += 1
        tail = len(ids)
        while tail > lead and self.kinds[ids[tail - 1]] == CONTROL:
            tail -= 1
        inner = ids[lead:tail]
        if any(c in inner for c in self.controls):
            return self._decode_slowly(ids)
        raw = b"".join([self.surface[i] for i in inner])
        if lead < len(ids) and self.prefix and self.kinds[ids[lead]] == NORMAL and self.pieces[ids[lead]].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_slowly(ids)

    def _decode_slowly(self, ids: Sequence[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in range(1, 5):
                    try:
                        c = bytes(run[i : i + n]).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1:
                        out.append(c)
                        i += n
                        break
                else:
                    out.append("�")
                    i += 1
            run.clear()

        fresh = self.prefix
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            flush()
            s = self.surface[i].decode("utf-8")
            if fresh and not out and self.kinds[i] == NORMAL and self.pieces[i].startswith(SPACE):
                s, fresh = s[1:], False
            out.append(s) if s else None
        flush()
        return "".join(out)


class Encoder:
    """Encodes batches of texts, remembering the ids of segments seen before."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None], end: bool = True) -> list[np.ndarray]:
        m = self.model
        found = [m.segment.findall(m.escaped(t)) if t else [] for t in texts]
        every = [s for f in found for s in f]
        if len(self.known) > REMEMBERED:
            self._forget()
        fresh = list(set(every).difference(self.known))
        if fresh:
            ids, offsets = m.merge_rounds(fresh)
            self.known.update(zip(fresh, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(fresh))))
            self.offsets = np.r_[self.offsets, offsets[1:] + self.offsets[-1]]
            self.flat = np.r_[self.flat, ids]
        which = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        lens = self.offsets[which + 1] - self.offsets[which]
        before = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=before[1:])
        ids = self.flat[np.arange(before[-1]) + np.repeat(self.offsets[which] - before[:-1], lens)]
        cuts = before[np.cumsum([0] + [len(f) for f in found])]
        tail = np.array([m.end], np.int32) if end else np.zeros(0, np.int32)
        return [np.r_[ids[cuts[i] : cuts[i + 1]], tail] for i in range(len(texts))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One model a worker process."""
    return Encoder(PieceModel(path))


def grouped(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """Runs of whole texts of about ``limit`` characters."""
    run: list[str | None] = []
    held = 0
    for t in texts:
        n = len(t) if t else 0
        if run and held + n > limit:
            yield run
            run, held = [], 0
        run.append(t)
        held += n
    if run:
        yield run


def encode(df: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",), decode: bool = True) -> DataFrame:
    """``keep`` columns with ``ids`` (array<int>, an end id last) and, if asked, ``decoded`` text.

    Columns of these names among ``keep`` give way to them.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            row = 0
            for texts in grouped(batch.column(0).to_pylist()):
                ids = coder.encode(texts)
                offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                cols = [c.slice(row, len(texts)) for c in batch.columns[1:]]
                cols.append(pa.ListArray.from_arrays(offsets, np.concatenate(ids)))
                if decode:
                    cols.append(pa.array([coder.model.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*names, "ids", *["decoded"] * decode])
                row += len(texts)

    names = [c for c in keep if c != "ids" and not (decode and c == "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(text, *names).mapInArrow(run, f"{schema}, ids array<int>" + ", decoded string" * decode)


def digests(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the number of ids and digests of the ids and of the decoded text, without shipping either."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        decimal = coder.model.decimal
        for batch in batches:
            n, a, b = [], [], []
            for texts in grouped(batch.column(1).to_pylist()):
                for x in coder.encode(texts):
                    ids = x.tolist()
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    b.append(hashlib.sha256(coder.model.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
