"""Cutting a plan's lineage where a table is read several times, and folders for tables that are stored on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the cluster names a shared folder (spark.checkpoint.dir); else, in local sessions, a cached table."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir"):
        return df.checkpoint()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df.persist()


def kept(df: DataFrame, name: str) -> DataFrame:
    """cut as a stored table: smaller than a checkpoint, and its count and size are known."""
    return stored(df, folder(df.sparkSession, name))


#: Rows of a stored table that go to the other side of a join, rather than both sides to a shuffle.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast while it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, *keys: str, name: str = "n", partitions: int | None = None) -> DataFrame:
    """df with dense numbers from 0 in the order of its keys: sorted ranges, each begun at the count of the rows before it."""
    ranges = df.repartitionByRange(*keys) if partitions is None else df.repartitionByRange(partitions, *keys)
    x = cut(ranges.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.expr("shiftright(_at, 33)")
    starts, total = [], 0
    for r in sorted(x.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()):
        starts.append((r["part"], total))
        total += r["rows"]
    spark = df.sparkSession
    x = x.withColumn("part", part).join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    return x.withColumn(name, F.col("start") + F.expr("_at & 8589934591")).drop("part", "start", "_at")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local session that doesn't set it gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
