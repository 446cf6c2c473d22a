"""Vectorised text kernels: whole Arrow batches become flat byte, word and hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call holds; it bounds a worker's memory and never cuts a text.
CHUNK_BYTES = 4_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED_CODES = _BYTE_CODES.copy()
_FOLDED_CODES[65:91] = _BYTE_CODES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1

#: Words are runs outside ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)


def powers(n: int) -> np.ndarray:
    """At least n powers of the base, kept for the next call."""
    global _POW
    if n > len(_POW):
        _POW = _powers(1 << n.bit_length())
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offsets = flat(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 offsets of each text's words; words end where texts do."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = member[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here[:n] & (~before[:n] | first[:n]))
    ends = np.flatnonzero(before & (~here | first))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of non-empty byte spans; ``fold`` lower-cases A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    before = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=before[1:])
    pos = np.arange(int(lens.sum())) - np.repeat(before, lens)
    codes = (_FOLDED_CODES if fold else _BYTE_CODES)[data[pos + np.repeat(starts, lens)]]
    codes *= powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(codes, before) + lens.astype(np.uint64))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019) ^ (b + np.uint64(0xD6E8FEB86659FD93)))


def ngrams(hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams within texts, and the index of each one's first word."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[: total - n + 1].copy()
    for k in range(1, n):
        out = pair(out, hashes[k : total - n + 1 + k])
    room = np.repeat(word_offsets[1:], np.diff(word_offsets))[: total - n + 1] - np.arange(total - n + 1)
    at = np.flatnonzero(room >= n)
    return out[at], at


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over [offsets[i], offsets[i+1]), empty ones 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
