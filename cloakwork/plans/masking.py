"""The masking job: documents in; masked documents, spans and mapping out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.catalogue import REGIONS, Rule, active_rules
from cloakwork.functions.text import normalise
from cloakwork.operators.candidates import PREFIX, candidates, describe, describe_key, matches, resolved, survivors
from cloakwork.operators.numbering import number_spans
from cloakwork.operators.rewrite import BLOCKS, mask_text
from cloakwork.operators.reuse import reuse
from cloakwork.operators.settle import settle


def _rules(regions: Iterable[str], profile: str, rules: Sequence[Rule] | None) -> Sequence[Rule]:
    return active_rules(regions, profile) if rules is None else rules


HITS = f"{PREFIX}hits"
OUTPUTS = ("clean_text", "candidates", "spans", "masked_text")


def _clean(df: DataFrame, text_col: str) -> DataFrame:
    taken = [c for c in df.columns if c in OUTPUTS or c.startswith("_cw_")]
    if taken:
        raise ValueError(f"columns that the result needs are there already: {', '.join(taken)}")
    return df.withColumn("clean_text", normalise(F.col(text_col)))


def _with_spans(df: DataFrame, text_col: str, rules: Sequence[Rule], spans: Column) -> DataFrame:
    """Add ``clean_text`` and ``spans``, an expression over the matches of the rules: one step from matches to finished spans."""
    return settle(matches(_clean(df, text_col), "clean_text", rules), "spans", spans).drop(HITS)


def find_candidates(df: DataFrame, text_col: str = "text", regions: Iterable[str] = REGIONS,
                    profile: str = "as_written", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``clean_text`` and ``candidates`` (spans before overlap resolution)."""
    active = _rules(regions, profile, rules)
    spans = F.transform("candidates", lambda c: describe(active, c))
    return candidates(_clean(df, text_col), "clean_text", active, "candidates").withColumn("candidates", spans).drop(BLOCKS)


def detect(df: DataFrame, text_col: str = "text", regions: Iterable[str] = REGIONS,
           profile: str = "as_written", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``clean_text`` and ``spans``: disjoint detections in text order.  No shuffle."""
    active = _rules(regions, profile, rules)
    return _with_spans(df, text_col, active, reuse(("resolved", tuple(active)), lambda: resolved(active))).drop(BLOCKS)


def mask(df: DataFrame, text_col: str = "text", regions: Iterable[str] = REGIONS, mode: str = "tag",
         profile: str = "as_written", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``clean_text``, ``spans`` (with replacements) and ``masked_text``.

    The text itself is never shuffled; every row is handled where it is read.
    """
    active = _rules(regions, profile, rules)
    numbered = reuse(
        ("numbered", mode, tuple(active)), lambda: number_spans(survivors(active), mode, lambda k: describe_key(active, k))
    )
    return mask_text(_with_spans(df, text_col, active, numbered))


def explode_spans(df: DataFrame, *id_cols: str, spans_col: str = "spans") -> DataFrame:
    """The long span table: one row per detection."""
    return df.select(*id_cols, F.explode(spans_col).alias("_s")).select(*id_cols, "_s.*")


def mapping(masked: DataFrame, *id_cols: str) -> DataFrame:
    """The mapping table of a :func:`mask` result: one record per span, values untrimmed."""
    long = explode_spans(masked, *id_cols)
    return long.select(
        *id_cols, "entity_id", "type", "region", "source", "replacement", "rule_id", "confidence",
        F.struct("start", "end").alias("position"), F.lit(True).alias("enabled"),
    )
