"""New container files, identified as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import containers


def new_files(spark: SparkSession, folder: str, *, files_at_once: int = 1000) -> DataFrame:
    """A stream of (path, modified, length, kind) of files that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)
    named = stream.select("path", F.col("modificationTime").alias("modified"), "length", "content")
    return containers.identified(named).drop("content")


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write what has come, once each, and stop."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
