"""Streams of documents through the stateless part of the engine: detection and merging.

Fakes are numbered over the whole collection, so replacing is a batch plan; what a stream can give at once is findings and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import Settings
from ..operators.detect import detect
from ..operators.scan import scan_counts


def documents_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files below a path as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def findings_stream(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """A stream of documents with their merged findings."""
    return detect(docs, settings, text_col)


def start_counts(docs: DataFrame, name: str, *keys: str, settings: Settings = Settings(), text_col: str = "text", checkpoint: str | None = None) -> StreamingQuery:
    """Running counts by ``keys`` and category in the in-memory table ``name``; ends when what is there has been read."""
    writer = scan_counts(findings_stream(docs, settings, text_col), *keys).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
