"""Helpers shared by the corpus operators: the shared folder, staged tables, word rules, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows up to which a table keyed by source, host and the like is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a local temporary folder stands in for it, but only if the master is local: on a
    cluster each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and lost executors cost no lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df is called so (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def boxed(df: DataFrame) -> Column:
    """All columns of df in one struct `_row`, so that names used on the way cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unboxed(df: DataFrame, replaced=()) -> list[Column]:
    """The columns of df's own rows out of `_row`, without those that an operator's results replace."""
    lost = {c.lower() for c in replaced}
    return [F.col("_row").getField(c).alias(c) for c in df.columns if c.lower() not in lost]


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (already staged) with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).collect()) <= rows else df


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words: characters that are no blank and stand at the start or after a blank."""
    return F.size(words_of(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return a task's freed memory to the system: Python workers live on and serve tasks of other operators."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass
