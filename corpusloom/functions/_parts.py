"""Arrow batches in parts: what a function holds at once follows neither the rows of a batch nor the length of a table."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or eight times the items of lists, that a function sees at once; a row is never cut.
PART_BYTES = 1_000_000


def runs(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of whole rows of about ``limit`` bytes."""
    is_list = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.list_value_length(column) if is_list else pc.binary_length(column)
    upto = np.r_[0, np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if is_list else 1) + 1)]
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(upto, upto[i] + limit, "right")) - 1))
        yield i, j
        i = j


def in_parts(function: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """The function of a batch's columns, called for runs of rows as the first column has them."""

    @functools.wraps(function)
    def whole(*columns: pa.Array) -> pa.Array:
        out = [function(*(c.slice(i, j - i) for c in columns)) for i, j in runs(columns[0])]
        return pa.concat_arrays(out) if out else function(*columns)

    return whole
