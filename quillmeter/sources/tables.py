"""Tables of the package's own making in the folder that driver and executors share, and scans spread over the cores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parquet bytes that a broadcast table may have; in memory it takes some times that.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine without it a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="quillmeter-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet and read again: what several parts of a query need is computed once, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """df marked for broadcast if it holds no more than so many rows and bytes of Parquet; else as it is, for a shuffled join. df is a stored table."""
    most = BROADCAST_BYTES if size is None else size
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if bytes_ <= most and df.limit(rows + 1).count() <= rows else df


def signature(spark: SparkSession, path: str) -> tuple:
    """What tells a file or a folder's files from others of that name: names, lengths, times of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return (path, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def spread(df: DataFrame, path: str) -> DataFrame:
    """The scan of a table that is one single file is dealt over the cores, as a file of one row group is read by one task; folders of files are left alone."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return df if status.isDirectory() else df.repartition(spark.sparkContext.defaultParallelism)
