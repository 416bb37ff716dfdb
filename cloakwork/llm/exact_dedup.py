"""Exact duplicates: group by a 128-bit content hash and by the bytes themselves.

Texts are equal when they are identical after lower-casing A-Z.  Grouping on (md5, text) compares
the bytes inside every hash group, so a collision makes two classes, never one.  Copies collapse
before the shuffle (partial aggregation), so a text that holds a third of all rows is one row per task.

Defined cases: a null text counts as empty; null ids lose against any id; rows that repeat both
id and text are reported each, and :func:`drop_exact` keeps one of them; an empty table gives an
empty result.  Only the id and text columns are read, so clashing names of others do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import LOWER, UPPER, fresh, lower_az, table, text_or_empty


def _keys(text: Column) -> tuple[Column, Column]:
    return F.unhex(F.md5(text)), F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per class of equal texts: ``md5``, ``sha``, ``keep_id``, ``group_size``."""
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    best = F.min if keep == "min" else F.max
    norm = docs.select(F.col(id_col).alias("id"), lower_az(text_or_empty(text_col)).alias("norm"))
    grouped = (
        norm.select("id", "norm", F.unhex(F.md5("norm")).alias("md5"))
        .groupBy("md5", "norm")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return grouped.select("md5", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` says which id of equal texts stays, the smallest or the largest.  Rows find their class
    by md5 and sha256 together; classes themselves were told apart by bytes.
    """
    norm = lower_az(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    md5, sha = _keys(F.col("norm"))
    rows = rows.select("id", md5.alias("md5"), sha.alias("sha"))
    joined = rows.join(classes(docs, id_col, text_col, keep), ["md5", "sha"])
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one per class.

    Rows are dealt out by id and hash, so a class with very many copies is spread.
    """
    md5_col, sha_col = fresh(docs, "_md5", "_sha")
    md5, sha = _keys(lower_az(text_or_empty(text_col)))
    rows = docs.withColumns({md5_col: md5, sha_col: sha}).alias("r")
    win = classes(docs, id_col, text_col, keep).alias("w")
    same = (
        F.col(f"r.{md5_col}").eqNullSafe(F.col("w.md5"))
        & F.col(f"r.{sha_col}").eqNullSafe(F.col("w.sha"))
        & F.col(f"r.{id_col}").eqNullSafe(F.col("w.keep_id"))
    )
    stay = rows.join(win, same, "left_semi")
    return stay.dropDuplicates([id_col, md5_col, sha_col]).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal texts; the largest id stays."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


ORACLE = {
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
