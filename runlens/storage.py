"""Folders of a shared file system, through the session's own Hadoop client (any store that
Spark reads): which writes are finished, and removing what they replaced."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``path/<prefix>=<n>`` (those with a success marker), ascending."""
    make, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith(f"{prefix}=") and fs.exists(make(status.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return bool(fs.exists(p))
