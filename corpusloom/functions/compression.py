"""Deflate sizes as a measure of redundancy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._parts import in_parts
from ._regex import columns


def _check(level: int) -> None:
    if not 0 <= level <= 9:
        raise ValueError(f"compression level must be from 0 to 9, not {level}")


#: Bytes handed to the compressor at once: the stored blocks of level 0, which else follow its caller's buffers.
BLOCK = 32768


def deflated(raw: bytes, level: int) -> int:
    """Bytes of the raw deflate stream, less the two that an empty one has."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    return sum(len(z.compress(raw[k : k + BLOCK])) for k in range(0, len(raw), BLOCK)) + len(z.flush()) - 2


def compressed_size(expr: Column | str, *, level: int = 6) -> Column:
    """Deflated size as bigint; null for null, 0 for empty text."""
    _check(level)

    def sizes(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else deflated(t, level) for t in text.cast(pa.binary()).to_pylist()], pa.int64())

    return F.arrow_udf(in_parts(sizes), "bigint")(columns(expr))


def compression_ratio(expr: Column | str, *, level: int = 6) -> Column:
    """UTF-8 bytes per deflated byte as float; null for null, NaN for empty text."""
    _check(level)

    def ratios(text: pa.Array) -> pa.Array:
        out = []
        for t in text.cast(pa.binary()).to_pylist():
            n = None if t is None else deflated(t, level)
            out.append(None if t is None else float("nan") if n == 0 else float(np.float32(len(t)) / np.float32(n)))
        return pa.array(out, pa.float32())

    return F.arrow_udf(in_parts(ratios), "float")(columns(expr))
