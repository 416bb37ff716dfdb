"""Helpers that several operators share."""

from __future__ import annotations

import shutil
import string
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
# Words of the contracts: runs of characters other than ASCII white space.  ``bytes.split()`` gives the same runs.
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, made of these, that the frame does not have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they can import it wherever they run.

    Also bounds the rows that a worker gets at once, in this session: texts may be long, and Spark's default of
    10,000 of them can outgrow an executor.
    """
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if not getattr(sc, "_cloakwork_shipped", False):
        root = Path(__file__).resolve().parents[2]
        archive = f"{tempfile.mkdtemp(prefix='cloakwork-')}/cloakwork"
        sc.addPyFile(shutil.make_archive(archive, "zip", root, "cloakwork"))
        sc._cloakwork_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  One of our own is set only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="cloakwork-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once, into the shared folder, and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, as a Parquet table, of which later steps read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
