"""Small helpers over the Hadoop file system API; they work for any path Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def all_exist(spark: SparkSession, paths: list[str]) -> bool:
    return all(exists(spark, p) for p in paths)


def child_names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written and nothing reads any more."""
    p, fs = _path(spark, path)
    fs.delete(p, True)
