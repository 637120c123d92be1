"""Incremental intake: files and events as streams through the same transformations as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossio.functions import cast as C


def incoming_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files of a landing folder with suffix and content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.withColumn("suffix", C.suffix(F.col("path")))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch of what is there to ``handle`` and ends; a restart goes on after the last batch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_lines(events: DataFrame) -> DataFrame:
    """Log lines of events (ts, event_type, user_id), for an append-only sink; batch or stream."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return events.select("event_id", F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), level, F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"))).alias("line"))


def append_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return log_lines(stream).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
