"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add (or replace) a costly column so that later filters on it do not recompute it.

    The optimizer pushes a filter below a projection by copying the projected expression into
    it; over a chain of costly columns that multiplies the work and the plan.  The output of a
    one-element ``explode`` cannot be copied, so a filter on this column stays above it, while
    filters on other columns still reach the scan.
    """
    others = [c for c in df.columns if c != name]
    fresh = f"_new_{name}" if name in df.columns else name
    out = df.select(*df.columns, F.explode(F.array(value)).alias(fresh))
    return out.select(*others, F.col(fresh).alias(name))


def ensure_checkpoint_dir(df: DataFrame, fallback: str | None = None) -> None:
    """The cluster names its shared checkpoint folder; set one only where it did not."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured or fallback:
        sc.setCheckpointDir(configured or fallback)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def shared_checkpoint(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Compute once, into the shared folder, what several later steps read."""
    ensure_checkpoint_dir(df, fallback)
    return df.checkpoint()
