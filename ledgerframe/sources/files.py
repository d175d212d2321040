"""Parquet datasets and copies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dataset import Dataset, dataset


def read_parquet(spark: SparkSession, name: str, path: str, keys: list[str], where: str | None = None, **options: object) -> Dataset:
    """A keyed dataset over Parquet files; where is a fixed SQL filter."""
    rows = spark.read.parquet(path)
    return dataset(name, rows.filter(where) if where else rows, keys, **options)


def copy_to(data: Dataset, path: str) -> None:
    """Writes a copy; a path that exists is refused."""
    data.data.write.mode("errorifexists").parquet(path)


def mirror_to(spark: SparkSession, data: Dataset, path: str) -> None:
    """Writes a local mirror; an earlier one is kept as path.bak."""
    jvm = spark.sparkContext._jvm
    now, old = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".bak")
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    copy_to(data, path)
