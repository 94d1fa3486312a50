"""Parquet tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fingerprint(spark: SparkSession, folder: str, name: str) -> str:
    """The table's files with their sizes and times: another string once the table has changed."""
    hadoop, said = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for file in sorted(table(spark, folder, name).inputFiles()):
        path = hadoop(file)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        said.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(said)
