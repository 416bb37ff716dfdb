"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

All stages but the last return the columns of ``documents``.  Empty tables, null texts, ties, repeated
rows and extra columns are treated as the operators say in ``cloakwork/llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import toxicity
from cloakwork.llm.common import remainder, shared_dir, table
from cloakwork.llm.exact_dedup import drop_exact
from cloakwork.llm.mixing import mix
from cloakwork.llm.near_dedup import drop_near
from cloakwork.llm.packing import pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labelled rows whose crc32 remainder by 3 is not 1."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_exact(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; documents of small sources come up to twice."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences of 2,048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole ``documents`` table; what lies between them is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # the classifier and the packing are not expressible in SQL; see tests/llm
