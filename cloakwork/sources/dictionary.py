"""A dictionary of pseudonyms on disk: one folder per version, each with the values that came new with it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "type string, region_key string, source string, n bigint"
VERSION = "version"


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to the end, on any file system that Spark writes to."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    folders = [f.getPath() for f in files.listStatus(root)]
    found = [(re.fullmatch(rf"{VERSION}=([0-9]+)", f.getName()), f) for f in folders]
    marker = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(m[1]) for m, f in found if m and files.exists(marker(f, "_SUCCESS")))


def read_dictionary(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """All values with their numbers as of a version, by default the last one.  Versions that broke off are not read."""
    versions = [v for v in committed_versions(spark, path) if up_to is None or v <= up_to]
    if not versions:
        return spark.createDataFrame([], FIELDS)
    return spark.read.schema(FIELDS).parquet(*[f"{path.rstrip('/')}/{VERSION}={v}" for v in versions])


def write_version(values: DataFrame, path: str, version: int) -> None:
    """Store the values of a new version.  What an earlier try left of it is replaced; a version that was finished is not."""
    if version in committed_versions(values.sparkSession, path):
        raise ValueError(f"version {version} is there already")
    rows = values.select("type", "region_key", "source", F.col("n").cast("bigint").alias("n"))
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{VERSION}={version}")
