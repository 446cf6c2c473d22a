"""Regular-expression tokens, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._regex import columns, translate

WORD = r"\w+"


def tokens(expr: Column | str, *, pattern: str = WORD) -> Column:
    """All non-overlapping matches, leftmost first, as array<string>; null for null."""
    return F.regexp_extract_all(columns(expr), F.lit(translate(pattern).java), F.lit(0))
