"""Resumable ingest: the file-by-file ledger as a file stream that stops when it has caught up.

There is no windowed or stateful stream here; the checkpoint plays the part of the list of
finished files, so an interrupted ingest goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def collect_arrivals(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 1000
) -> None:
    """Appends the rows of files that were not taken before, with the file each row came from."""
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
