"""Results that are needed more than once, kept in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of the warehouse, which is shared too."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Gives a finished folder its name; if another writer was first, theirs stays and this one goes."""
    fs, at = _file_system(spark, old)
    if fs.exists(to := spark._jvm.org.apache.hadoop.fs.Path(new)) or not fs.rename(at, to):
        fs.delete(at, True)


def table_state(spark: SparkSession, path: str) -> str:
    """A digest of a table's path and of its files' count, bytes and newest time: changes when the table does."""
    fs, at = _file_system(spark, path)
    found, n, size, newest = fs.listFiles(at, True), 0, 0, 0
    while found.hasNext():
        status = found.next()
        n, size, newest = n + 1, size + status.getLen(), max(newest, status.getModificationTime())
    return hashlib.sha256(f"{at.makeQualified(fs.getUri(), fs.getWorkingDirectory())}|{n}|{size}|{newest}".encode()).hexdigest()[:32]


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``; where that is unset, in a folder of the warehouse, which is shared too."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_parquet(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder: like ``materialise``, at a fraction of the disk."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
