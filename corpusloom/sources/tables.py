"""Reading tables, small in-memory tables, and files that functions need on every executor."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table of a folder; only the named columns are scanned."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def from_rows(spark: SparkSession, columns: Mapping[str, Iterable], schema: str) -> DataFrame:
    """A table from columns in memory."""
    return spark.createDataFrame(list(zip(*columns.values())), schema)


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a model or tokenizer file to all executors; ``shipped`` finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    return SparkFiles.get(name)
