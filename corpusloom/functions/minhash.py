"""MinHash signatures of token shingles, as hexadecimal text."""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._parts import in_parts
from .tokens import WORD, tokens

P61 = np.uint64(2**61 - 1)
#: Default seed: any 32 bytes will do.
SEED = hashlib.sha256(b"token shingle permutations").digest()
_LOW31, _LOW30 = np.uint64(2**31 - 1), np.uint64(2**30 - 1)
#: Shingles that are permuted at once: their products stay in a core's cache.
BLOCK = 256


@lru_cache(maxsize=32)
def permutations(seed: bytes, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Multipliers from 1, addends from 0 (both below 2^61 - 1), and the shingle hash's seed.

    Drawn a, b, a, b, ... and then the hash seed, uniformly, from SHA-256 of the seed and a counter. Another
    generator can take this function's place where signatures of another library are to be matched.
    """
    drawn, counter = [], 0

    def below(limit: int, least: int = 0) -> int:
        nonlocal counter
        while True:
            counter += 1
            x = int.from_bytes(hashlib.sha256(seed + counter.to_bytes(8, "little")).digest()[:8], "little") & (2**61 - 1)
            if least <= x < limit:
                return x

    for _ in range(n):
        drawn.append((below(2**61 - 1, 1), below(2**61 - 1)))
    last = hashlib.sha256(seed + b"shingle").digest()[:8]
    pairs = np.array(drawn, np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy(), int.from_bytes(last, "little")


def mod61(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, for any unsigned 64-bit x."""
    x = (x & P61) + (x >> np.uint64(61))
    return np.where(x >= P61, x - P61, x)


def affine61(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(a * x + b) modulo 2^61 - 1 of numbers below it, without wider integers."""
    x1, x0 = x >> np.uint64(31), x & _LOW31
    a1, a0 = a >> np.uint64(31), a & _LOW31
    mid = x1 * a0 + x0 * a1
    product = (x1 * a1 << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + x0 * a0
    return mod61(mod61(product) + b)


def shingle_hashes(words: list[str], window: int, seed: int, family: str) -> np.ndarray:
    """Hashes of all runs of ``window`` tokens, the latest token first, modulo 2^61 - 1."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if family == "md5":
        parts = [w + "\x1f" for w in words]
        return np.array([int(hashlib.md5("".join(reversed(parts[i : i + window])).encode()).hexdigest()[:15], 16) for i in range(n)], np.uint64)
    raw = [w.encode() + b"\xff" for w in words]
    raw.reverse()
    digest, every = xxhash.xxh3_64_intdigest, b"".join(raw)
    at = [0, *itertools.accumulate(map(len, raw))]
    return mod61(np.array([digest(every[i:j], seed) for i, j in zip(at, at[window:])], np.uint64))


@lru_cache(maxsize=32)
def _halves(a: bytes, b: bytes) -> tuple[np.ndarray, ...]:
    """Multipliers of a number's high and low bits, and with the addends their shares of the modulus, 2^-16 too much."""
    low, add = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    high = affine61(low, np.uint64(0), np.uint64(2**31))
    p = float(P61)
    return tuple(c[:, None] for c in (high, low, add, high / p, low / p, add / p + 2.0**-16))


def minima(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The least (a * x + b) modulo 2^61 - 1 over all x, one for each a and b; 2^64 - 1 without any x.

    The quotient is taken in floating point, where it is off by less than 2^-19. With 2^-16 added it is never too
    small, and too large only where the remainder lies within 2^-15 of the modulus: that one turns up beyond
    2^63, and is computed again if no other lies below it.
    """
    least = np.full(len(a), 2**64 - 1, np.uint64)
    high, low, add, high_share, low_share, add_share = _halves(a.tobytes(), b.tobytes())
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        x1, x0 = part >> np.uint64(31), part & _LOW31
        #: Not a matrix product: its library would start threads beside those of the other tasks.
        share = high_share * x1.astype(np.float64)
        share += low_share * x0.astype(np.float64)
        share += add_share
        quotient = share.astype(np.int64).view(np.uint64)
        rest = low * x0
        rest += high * x1
        rest += add
        quotient *= P61
        rest -= quotient
        np.minimum(least, rest.min(axis=1), out=least)
    late = np.flatnonzero(least >= P61 - (P61 >> np.uint64(14))) if len(x) else ()
    for k in late:
        least[k] = affine61(a[k], b[k], x).min()
    return least


def signature(words: list[str], a: np.ndarray, b: np.ndarray, hash_seed: int, buckets: int, bsize: int, window: int, family: str) -> str:
    x = shingle_hashes(words, window, hash_seed, family)
    least = minima(a, b, x)
    if family == "md5":
        return "".join(hashlib.md5(",".join(map(str, least[k * bsize : (k + 1) * bsize].tolist())).encode()).hexdigest() for k in range(buckets))
    raw = least.astype(">u8").tobytes()
    if bsize == 1:
        return raw.hex()
    return "".join(xxhash.xxh3_128_hexdigest(raw[8 * bsize * k : 8 * bsize * (k + 1)]) for k in range(buckets))


def minhash(expr: Column | str, *, tokenizer_pattern: str = WORD, seed: bytes | list[int] = SEED, buckets: int = 14, bsize: int = 8, window: int = 5, hash_family: str = "xxh3") -> Column:
    """Hexadecimal signature: 32 digits per bucket of ``bsize`` minimum hashes, or 16 per hash with ``bsize=1``.

    Equal buckets make candidates; ``bsize=1`` leaves the banding open. Texts with fewer than ``window`` tokens
    all get one constant signature; null for null. ``hash_family='md5'`` computes the same in a form that SQL can check.
    """
    seed = bytes(seed)
    if len(seed) != 32:
        raise ValueError("the seed must have 32 bytes")
    if min(buckets, bsize, window) < 1:
        raise ValueError("buckets, bsize and window must be at least 1")
    if hash_family not in ("xxh3", "md5"):
        raise ValueError("hash_family must be xxh3 or md5")
    a, b, hash_seed = permutations(seed, buckets * bsize)

    def sign(words: pa.Array) -> pa.Array:
        #: Far faster than a list of lists, whose items pyarrow makes one by one.
        flat = words.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        rows = zip([0, *ends], ends, words.is_null().to_pylist())
        return pa.array([None if gone else signature(flat[i:j], a, b, hash_seed, buckets, bsize, window, hash_family) for i, j, gone in rows], pa.string())

    return F.arrow_udf(in_parts(sign), "string")(tokens(expr, pattern=tokenizer_pattern))


def bucket(signature_col: Column | str, number: int) -> Column:
    """Bucket ``number`` (from 0) of a signature with ``bsize`` over 1."""
    return F.substring(signature_col, 32 * number + 1, 32)
