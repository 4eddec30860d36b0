"""Dumps as streams: the same extractor over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.sources.dump import revisions_of


def read_dump_stream(spark: SparkSession, folder: str, entities: str = "text", timestamps: str = "strict", max_files: int = 16) -> DataFrame:
    """A streaming frame of revisions of the files that appear in ``folder``; a page is wholly in one file."""
    chunks = spark.readStream.option("lineSep", "</page>").option("maxFilesPerTrigger", max_files).text(folder)
    return revisions_of(chunks, entities, timestamps)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append everything that is there now to Parquet, exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
