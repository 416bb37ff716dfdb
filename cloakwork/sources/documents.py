"""Reading documents and writing masked text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
                   id_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read documents as rows: parquet/orc/json tables, or text files (one document per file).

    Text files get ``doc_id`` from their path, so ids are stable across runs and executors.
    """
    if fmt == "text":
        df = spark.read.text(path, wholetext=True).withColumnRenamed("value", text_col)
        return df.select(F.col("_metadata.file_path").alias(id_col or "doc_id"), text_col)
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core some documents when the input has fewer splits than cores.

    For small inputs on one machine, such as benchmarks: it deals the whole rows out anew.  Nothing in
    the library calls it; large inputs should rather be read with smaller splits.
    """
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(cores * 4, *keys)


def apart(path: str, mapping_path: str) -> None:
    """Refuse a mapping path inside the masked output or around it."""
    a, b = path.rstrip("/") + "/", mapping_path.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError("write the mapping outside the masked output: it holds the raw values")


def write_masked(df: DataFrame, path: str, mapping: DataFrame | None = None, mapping_path: str | None = None,
                 fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write masked documents; the mapping holds the raw values and goes to a path of its own."""
    if mapping is not None:
        if not mapping_path:
            raise ValueError("a mapping needs its own path")
        apart(path, mapping_path)
    df.write.format(fmt).mode(mode).save(path)
    if mapping is not None:
        mapping.write.format(fmt).mode(mode).save(mapping_path)


DOC_KEY = "doc_key"


def write_restorable(masked: DataFrame, records: DataFrame, id_cols: Sequence[str], tables: tuple[str, str], buckets: int,
                     folders: tuple[str, str] | None = None) -> None:
    """Write masked documents and their mapping as two tables that later meet without a shuffle.

    Both are bucketed and sorted by ``doc_key``, which is made of the ids and never null.  ``folders`` are places
    of their own for external tables; the mapping holds the raw values.
    """
    if folders:
        apart(*folders)
    key = F.to_json(F.struct(*id_cols), {"ignoreNullFields": "false"})
    for k, (rows, name) in enumerate(zip((masked, records), tables, strict=True)):
        writer = rows.withColumn(DOC_KEY, key).write.bucketBy(buckets, DOC_KEY).sortBy(DOC_KEY)
        (writer.option("path", folders[k]) if folders else writer).saveAsTable(name)


def read_restorable(spark: SparkSession, tables: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_restorable` wrote.  Restore by ``[DOC_KEY]`` with ``null_ids=False``: each bucket is restored where it is read."""
    return tuple(spark.table(name) for name in tables)
