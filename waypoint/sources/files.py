"""File listing on the cluster's file system (Hadoop FS, so shared storage works)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def touch(spark: SparkSession, path: str) -> None:
    """An empty file at ``path``."""
    fs, p = _fs(spark, path)
    fs.create(p).close()


def list_names(spark: SparkSession, folder: str, pattern: str | None = None) -> list[str]:
    """Entry names directly under ``folder`` (files or part folders), regex-filtered."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = sorted(st.getPath().getName() for st in fs.listStatus(p))
    names = [n for n in names if not n.startswith(("_", "."))]
    if pattern:
        rx = re.compile(pattern)
        names = [n for n in names if rx.search(n)]
    return names
