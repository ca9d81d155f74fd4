"""Structured Streaming into evolving tables, and event-time rollups of what was ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emergent.operators.ingest import ingest
from emergent.operators.transforms import Registry
from emergent.sources.store import Table


def ingest_stream(payloads: DataFrame, table: Table, registry: Registry, name: str, transform: str | None = None, explode: str | None = None, ignore_errors: bool = False) -> DataStreamWriter:
    """A writer that ingests each micro-batch; a batch that is delivered again after a failure changes nothing, as its number is in the manifest."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ingest(table, batch, registry, transform, explode, ignore_errors, batch=(name, number))

    return payloads.writeStream.queryName(name).foreachBatch(one)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by keys and event-time window, for streams and tables alike; rows later than ``late`` are dropped from streams."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of activity by keys, closed after ``gap``."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row for each key; in a stream, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
