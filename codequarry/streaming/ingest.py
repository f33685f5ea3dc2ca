"""Structured Streaming over arriving sources: each micro-batch is indexed by version, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.store import Store
from codequarry.sources.files import SOURCE_SCHEMA


def read_sources(spark: SparkSession, path: str, *, most_files: int = 1000) -> DataFrame:
    """JSON lines of sources (path, source, ecosystem, name, version, source_ref, ordinal) as files arrive."""
    return spark.readStream.schema(SOURCE_SCHEMA).option("maxFilesPerTrigger", most_files).json(path)


def ingest(sources: DataFrame, store: Store, checkpoint: str, *, min_mass: int = 15, once: bool = True) -> StreamingQuery:
    """Index a stream. A version must arrive within one batch, as its partition is replaced whole."""

    def put(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.index(batch, min_mass=min_mass)

    writer = sources.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def package_progress(events: DataFrame, *, delay: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts of results by window and status, for events with ts and status; late ones go beyond delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n"))
