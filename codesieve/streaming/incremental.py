"""Scan of files as they arrive in a landing folder.

A file is whole inside its row, so each micro-batch runs the batch scan, blocks included, and
is exact. A file that arrives again unchanged within the delay is not scanned again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codesieve.plans.scan import scan_issues
from codesieve.schemas import CODE_FILES
from codesieve.session import configure


def stream_files(spark: SparkSession, landing: str, delay: str = "1 hour",
                 files_per_trigger: int = 1000) -> DataFrame:
    """Arriving files, each path and content once within ``delay``. The delay counts from the
    arrival: by ``modified_at`` an old file would be late and be lost."""
    return (
        spark.readStream.schema(CODE_FILES).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(landing)
        .withColumn("arrived_at", F.current_timestamp())
        .withWatermark("arrived_at", delay)
        .dropDuplicatesWithinWatermark(["repo_path", "file_path", "content_hash"])
    )


def start_incremental_scan(files: DataFrame, target: str, checkpoint: str,
                           available_now: bool = False) -> StreamingQuery:
    """Writes the issues of each micro-batch below ``target``.

    A batch writes to a folder named by its number and overwrites it, so a batch that is run
    again after a failure leaves no issue twice.
    """

    def scan_batch(batch: DataFrame, number: int) -> None:
        scan_issues(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    configure(files.sparkSession)
    writer = files.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
