"""Streams of chunk and event files (an extension): each row once, state by key, results that equal the batch's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def chunk_stream(spark: SparkSession, path: str, schema: str, stamp: str = "arrived", late: str = "1 hour") -> DataFrame:
    """New chunk files, each chunk_id once within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(stamp, late).dropDuplicatesWithinWatermark(["chunk_id"])


def running_counts(events: DataFrame, stamp: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, window), key).agg(F.count(F.lit(1)).alias("n"))


def upsert_stream(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch to write; the checkpoint folder must be shared."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, schema, files_each: int = 1000) -> DataFrame:
    """The Parquet files of a folder as they arrive, files_each at most in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def source_totals(events: DataFrame, source: str, key: str, stamp: str, value: str) -> DataFrame:
    """source, first_seen, last_seen, n, total: one row for each source, over events of which each key counts once.

    On a stream this keeps a state: the keys that were seen (use a watermark on ``events`` to bound them where keys don't come back for
    long) and one row for each source. Partial sums are made before the shuffle, so a source of a third of the rows is no hot task.
    """
    once = events.dropDuplicates([key])
    return once.groupBy(source).agg(F.min(stamp).alias("first_seen"), F.max(stamp).alias("last_seen"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


class UpsertFolder:
    """Changed rows of each micro-batch in a folder of its own; a batch that runs again overwrites its folder, so nothing counts twice."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path.rstrip("/"), key

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def run(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts writing the changes that the state yields (mode update), for all files that are there."""
        return changes.writeStream.outputMode("update").foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The last row of each key."""
        rows = spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}/batch=*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long"))
        names = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*")
