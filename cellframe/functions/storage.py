"""Tables written to the shared folder and read again, and exact row numbers from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a local temporary folder stands in for it, but only if the master is local: on a
    cluster each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cells-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and lost executors cost no lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df (already staged) with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in whatever store its path names; False if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ranked(df: DataFrame, keys: list[str], order: list[str], **names: list[str]) -> DataFrame:
    """df with row numbers from 0 within groups of keys, in the order of `order`, without a window over a group.

    names: column -> the keys that its numbers start anew for, a prefix of keys.  Rows are dealt by ranges of (keys,
    order), so that a large group lies in many tasks; each numbers its rows, and what stands before a task's part of
    a group is the running total over the parts, which are few.  The numbers are written, and fixed from then on.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = staged(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    for name, own in names.items():
        part = held.groupBy(*own, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = part.select(*[F.col(c).alias(f"_key_{c}") for c in own], F.col("_part").alias("_of"), "_first", before.alias("_before"))
        same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in own]  # rows with a null key are a group like any other
        held = held.join(part, [F.col("_part") == F.col("_of"), *same]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop(*part.columns)
    return held.drop("_part", "_at")

