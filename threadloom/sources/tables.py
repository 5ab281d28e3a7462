"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in a folder; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_marks(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of every file below the paths, on any store Hadoop can reach; sorted."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf).listFiles(target, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header under a given schema; no inference, so the file is read once.  Empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
