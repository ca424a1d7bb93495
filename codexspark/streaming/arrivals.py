"""Containers that arrive in a folder, decoded as a stream.

Each file is a row and each of its results depends on that row alone, so nothing is kept between batches: header and
record tables are plain projections of the stream, and what needs a document's records together runs batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*", per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content, doc_id) of files as they arrive; at most per_batch files go into one batch,
    the rest into the next."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path)
    return files.withColumn("doc_id", F.xxhash64("path"))


def written(files: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start writing build(batch of containers) to Parquet below out, a folder for each batch: a batch that is run again
    after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
