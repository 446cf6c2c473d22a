"""Relational helpers around the text functions; everything else is plain DataFrame code."""

from .relational import bucket_columns, columns_ending, first_row, maxima_at, spread, unnest, with_signals

__all__ = ["bucket_columns", "columns_ending", "first_row", "maxima_at", "spread", "unnest", "with_signals"]
