"""Subword token ids with a tokenizer of the ``tokenizers`` library."""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._files import resolve
from ._parts import in_parts
from ._regex import columns


@lru_cache(maxsize=8)
def _from_file(path: str, changed: float):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=8)
def _from_json(written: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(written)


def from_path(path: str):
    """The tokenizer of a file, read once per worker and change."""
    place = resolve(path)
    return _from_file(place, os.path.getmtime(place))


def ids_of(own, rows: list[str | None]) -> pa.Array:
    """Ids of each text without special tokens."""
    found = iter(own.encode_batch_fast([t for t in rows if t is not None], add_special_tokens=False))
    return pa.array([None if t is None else next(found).ids for t in rows], pa.list_(pa.int64()))


def tokenize(expr: Column | str, *, tokenizer) -> Column:
    """Ids without special tokens as array<bigint>; null for null, [] for empty text.

    ``tokenizer`` is a Tokenizer, or the path of its JSON file, one that every executor sees or that was sent to them.
    """
    from tokenizers import Tokenizer

    if not isinstance(tokenizer, (Tokenizer, str)):
        raise ValueError(f"tokenizer must be a path or a Tokenizer, not {type(tokenizer)}")
    written = None if isinstance(tokenizer, str) else tokenizer.to_str()
    path = tokenizer if written is None else None

    def encode(text: pa.Array) -> pa.Array:
        return ids_of(from_path(path) if written is None else _from_json(written), text.to_pylist())

    return F.arrow_udf(in_parts(encode), "array<bigint>")(columns(expr))
