"""Masking on a stream.  Detection and masking are row-local, so no state or watermark is needed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cloakwork.catalogue import REGIONS
from cloakwork.plans.masking import mapping, mask
from cloakwork.sources.documents import apart

BATCH = "batch"


def read_document_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                         max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def mask_stream(stream: DataFrame, text_col: str = "text", regions: Iterable[str] = REGIONS, mode: str = "tag",
                profile: str = "as_written") -> DataFrame:
    """The batch plan, applied to a streaming DataFrame; the raw text is dropped."""
    return mask(stream, text_col, regions, mode, profile).drop(text_col, "clean_text")


def write_masked_stream(masked: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                        available_now: bool = True) -> StreamingQuery:
    """Append masked text (without spans, which hold raw values) to files, exactly once per input file."""
    writer = masked.drop("spans").writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def _folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{BATCH}={batch_id}"


def is_published(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether a batch has been written to the end, on any file system that Spark writes to."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{_folder(path, batch_id)}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def publish_batch(masked: DataFrame, batch_id: int, id_cols: Sequence[str], path: str, mapping_path: str) -> None:
    """Write a batch of :func:`mask_stream` to both sinks, each once per batch id.

    Each sink has a folder per batch.  One that has been written to the end is left alone, so a batch
    that is delivered again adds nothing; one that broke off is written anew.  The mapping goes first: no masked text is out
    before the values that restore it are safe.  The spans are computed once for both sinks; if an executor takes
    its part of them along, that part is computed again.
    """
    spark = masked.sparkSession
    todo = [p for p in (mapping_path, path) if not is_published(spark, p, batch_id)]
    if not todo:
        return
    held = masked.persist(StorageLevel.MEMORY_AND_DISK) if len(todo) > 1 else masked
    try:
        for sink in todo:
            rows = mapping(held, *id_cols) if sink == mapping_path else held.drop("spans")
            rows.write.mode("overwrite").parquet(_folder(sink, batch_id))
    finally:
        if len(todo) > 1:
            held.unpersist()


def write_stream_with_mapping(masked: DataFrame, id_cols: Sequence[str], path: str, mapping_path: str, checkpoint: str,
                              available_now: bool = True) -> StreamingQuery:
    """Masked text to ``path``, and to ``mapping_path`` the records that restore it (see :func:`publish_batch`).

    ``masked`` is a result of :func:`mask_stream`.  The paths must not lie in each other, as the mapping holds the raw
    values.  Both are Parquet, partitioned by the number of the batch.
    """
    apart(path, mapping_path)

    def publish(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, batch_id, id_cols, path, mapping_path)

    writer = masked.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_published(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    """What :func:`write_stream_with_mapping` has written to one of its paths, all batches or those up to a number."""
    rows = spark.read.parquet(path)
    return (rows if up_to is None else rows.where(rows[BATCH] <= up_to)).drop(BATCH)
