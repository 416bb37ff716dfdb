"""Where personal data sits: counts of detections over a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pii_profile(spans: DataFrame, by: Sequence[str] = ("type", "region", "rule_id")) -> DataFrame:
    """Detections, distinct values and mean confidence per group."""
    return spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("detections"),
        F.countDistinct("source").alias("distinct_values"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def pii_rollup(spans: DataFrame, *levels: str) -> DataFrame:
    """Detections with subtotals along the levels."""
    return spans.rollup(*levels).agg(F.count(F.lit(1)).alias("detections"))


def documents_with_pii(masked: DataFrame, *by: str) -> DataFrame:
    """Share of documents with at least one detection, per group.  One aggregation, no exploding."""
    return masked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.size("spans") > 0).alias("with_pii"),
        F.sum(F.size("spans")).alias("detections"),
    )


LG_K = 14  # 2**14 registers a sketch: one deviation of an estimate is 0.8 % of it


def profile_sketches(spans: DataFrame, by: Sequence[str] = ("type", "region", "rule_id")) -> DataFrame:
    """What a run stores for :func:`merged_profile`: per group detections, sum of confidence, and a sketch of its values.

    A sketch has a bounded size, whatever the number of values, so profiles of many runs add up without their spans.
    """
    return spans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("detections"),
        F.sum(F.round(100 * F.col("confidence")).cast("bigint")).alias("confidence_percent"),
        F.hll_sketch_agg("source", F.lit(LG_K)).alias("values"),
    )


def merged_profile(sketches: DataFrame, by: Sequence[str] = ("type", "region", "rule_id")) -> DataFrame:
    """The profile over all runs whose sketches are given, as one DataFrame; distinct values are estimates, the rest is exact."""
    merged = sketches.groupBy(*by).agg(
        F.sum("detections").alias("detections"), F.sum("confidence_percent").alias("_sure"), F.hll_union_agg("values").alias("_values")
    )
    return merged.select(
        *by, "detections", F.hll_sketch_estimate("_values").alias("distinct_values"),
        F.round(F.col("_sure") / (100 * F.col("detections")), 4).alias("mean_confidence"),
    )
