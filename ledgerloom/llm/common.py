"""Shared pieces: the shared work folder, staged tables and the bounded-size guard for broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast hints are given only to tables counted at no more rows than this.
MAX_BROADCAST_ROWS = 400_000


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset: in a local session the machine's temporary
    folder, which is all that there is; on a cluster the warehouse, which its machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing done so far."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables staged on the way to a result, in one folder that is removed once the result is staged elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, work_dir(spark), 0

    def __enter__(self) -> Scratch:
        return self

    def stage(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return stage(df, f"{self.folder}/{self.tables}")

    def __exit__(self, *failure) -> None:
        if self.tables:
            remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own staged tables, in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; a larger table is left to a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that what a task holds of its texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give back what a task has freed: workers live on, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
