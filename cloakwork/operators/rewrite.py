"""Splice replacements into a text by offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import blocks, slice_blocks
from cloakwork.operators.reuse import reuse

BLOCKS = "_cw_blocks"


def rewrite(text: Column, parts: Column, spans: Column, value: Callable[[Column], Column]) -> Column:
    """The text with each (disjoint, sorted) span replaced by ``value(span)``.

    ``parts`` are the blocks of the text; the text itself is passed through where there is
    nothing to replace.
    """
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            slice_blocks(parts, F.coalesce(F.get(spans, i - 1).end, F.lit(0)), s.start), value(s)
        ),
    )
    tail = slice_blocks(parts, F.get(spans, F.size(spans) - 1).end, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def required(span: Column) -> Column:
    """The replacement of a span; a span without one fails the query, as its source must not get out."""
    return F.coalesce(span.replacement, F.raise_error(F.lit("a span has no replacement")).cast("string"))


def mask_text(df: DataFrame, text_col: str = "clean_text", spans_col: str = "spans", out_col: str = "masked_text",
              value: Callable[[Column], Column] = required) -> DataFrame:
    """Add the rewritten text; uses the text blocks of an earlier step if they are still there."""
    text, spans = F.col(text_col), F.col(spans_col)
    if BLOCKS not in df.columns:
        df = df.withColumn(BLOCKS, F.when(F.size(spans) > 0, blocks(text)))
    new = reuse(("rewrite", text_col, spans_col, value), lambda: rewrite(text, F.col(BLOCKS), spans, value))
    return df.withColumn(out_col, new).drop(BLOCKS)
