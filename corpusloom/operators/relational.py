"""Unnesting, signature slices, signal columns and whole-table comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket


def unnest(df: DataFrame, name: str) -> DataFrame:
    """The fields of a struct column in its place at the end; a null struct gives nulls."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.col(f"`{name}`.*"))


def with_signals(df: DataFrame, **signals: Column) -> DataFrame:
    """All signals in one projection, so that their Arrow functions share one pass over the batches."""
    return df.withColumns(signals)


def bucket_columns(df: DataFrame, signature: str, buckets: int, prefix: str = "bucket_") -> DataFrame:
    """One column per signature bucket, for equality joins."""
    return df.withColumns({f"{prefix}{k}": bucket(signature, k) for k in range(buckets)})


def columns_ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def first_row(df: DataFrame, *order: str):
    """The first row in the given order, as one top-1 aggregation rather than a sort of everything."""
    return df.orderBy(*order).limit(1).first()


def maxima_at(df: DataFrame, names: list[str], row: Column) -> bool:
    """Whether the rows that satisfy ``row`` attain the maximum of every named column."""
    tops = df.agg(*[F.max(F.col(f"`{n}`")).alias(f"m{i}") for i, n in enumerate(names)], *[F.max(F.when(row, F.col(f"`{n}`"))).alias(f"r{i}") for i, n in enumerate(names)])
    return bool(tops.select(reduce(lambda a, b: a & b, [F.col(f"m{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(names))])).first()[0])


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a few small files leave most of them idle; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
