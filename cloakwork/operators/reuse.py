"""Keep built column expressions."""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column

_KEPT = "_cloakwork_columns"


def reuse(key: Hashable, build: Callable[[], Column]) -> Column:
    """Build a column expression once per Spark context.

    The large expressions name columns only, so they fit any DataFrame; building one takes
    thousands of calls into the JVM.
    """
    sc = SparkContext._active_spark_context
    if sc is None:
        return build()
    kept = sc.__dict__.setdefault(_KEPT, {})
    if key not in kept:
        kept[key] = build()
    return kept[key]
