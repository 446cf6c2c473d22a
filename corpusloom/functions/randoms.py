"""Random bytes and identifiers, one per row. Build them after filters: each plan draws anew."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def samplebyte(expr: Column | str | None = None) -> Column:
    """A smallint from 1 to 64, x with probability 2^-x, so that x > k keeps one row of 2^k.

    ``expr`` only says for which rows; nulls get a byte too. A double has 53 random bits, so bytes above 53 don't occur.
    """
    return F.least(F.lit(64), F.floor(-F.log2(F.lit(1.0) - F.rand())) + 1).cast("smallint")


def uuid4(expr: Column | str | None = None) -> Column:
    """A random version-4 identifier of 32 hexadecimal digits without dashes, for null rows too."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
