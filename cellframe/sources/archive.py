"""Archive tables laid out for their joins and groups: bucketed by the keys that hold them together.

Curves lie by path, atoms and cells by structure.  Tables bucketed alike join, and aggregate by their key, without an
exchange: the shuffle is paid once, when a table is written.  A structure or file with a large part of all rows would fill one bucket; tables
with such keys are better left unbucketed, where adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BUCKETS = 64


def store(df: DataFrame, name: str, key: str, folder: str | None = None, buckets: int = BUCKETS, overwrite: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Write df as table `name`, in buckets of key sorted by it (and order); fails if the table exists, unless overwrite.

    folder: where its files lie, else the warehouse.  One task writes a bucket, so there are `buckets` files.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order).mode("overwrite" if overwrite else "errorifexists")
    if folder:
        writer = writer.option("path", folder)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
