"""Signals of a stream of documents."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_signals(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, signals: dict[str, Column], *, files_per_trigger: int | None = None, available_now: bool = True, names: str | None = None) -> StreamingQuery:
    """Reads Parquet files as they arrive, adds the signals, and appends to a Parquet sink exactly once.

    ``source`` is a folder; ``names`` is a pattern of the file names to read.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if names:
        reader = reader.option("pathGlobFilter", names)
    out = reader.parquet(source).withColumns(signals).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
