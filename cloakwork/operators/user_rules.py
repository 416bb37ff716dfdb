"""User-defined literal rules: exact, case-sensitive texts with an entity type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.catalogue import MANUAL_BASIS, MANUAL_PRIORITY, MANUAL_RULE
from cloakwork.functions.replacements import is_entity_type
from cloakwork.functions.text import trim_space
from cloakwork.operators.literals import RULES, attach_rules, literal_hits
from cloakwork.operators.numbering import fill_replacements
from cloakwork.operators.overlaps import sort_key, sweep
from cloakwork.operators.rewrite import mask_text
from cloakwork.operators.reuse import reuse
from cloakwork.operators.settle import settle

_FIRST_MANUAL = 1 << 30


def dedupe_rules(rules: DataFrame) -> DataFrame:
    """One rule per (source, type).  An ``ord`` column, if there is one, keeps the first position."""
    scope = [c for c in rules.columns if c not in ("source", "type", "ord")]
    if "ord" in rules.columns:
        return rules.groupBy(*scope, "source", "type").agg(F.min("ord").alias("ord"))
    return rules.select(*scope, "source", "type").dropDuplicates([*scope, "source", "type"])


def rules_from_selections(selections: DataFrame) -> DataFrame:
    """Rules from selected texts: trailing blanks and line ends go, blank selections too; type USER by default.

    An unknown type fails the query.
    """
    type_ = F.coalesce(F.col("type"), F.lit("USER")) if "type" in selections.columns else F.lit("USER")
    scope = [c for c in selections.columns if c not in ("source", "type")]
    cleaned = selections.select(*scope, F.regexp_replace("source", r"[ \r\n]+\z", "").alias("source"), type_.alias("type"))
    refuse = F.raise_error(F.concat(F.lit("unknown entity type: "), F.col("type"))).cast("string")
    known = cleaned.where(trim_space(F.col("source")) != "").withColumn(
        "type", F.when(is_entity_type(F.col("type")), F.col("type")).otherwise(refuse)
    )
    return dedupe_rules(known)


def retype_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Give rules another type: ``changes(source, type, new_type)``."""
    joined = rules.join(changes.select("source", "type", "new_type"), ["source", "type"], "left")
    scope = [c for c in rules.columns if c not in ("source", "type")]
    return dedupe_rules(
        joined.select(*scope, "source", F.coalesce("new_type", "type").alias("type"))
    )


def remove_rules(rules: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop the rules listed in ``removed(source, type)``, and with them all their occurrences."""
    return rules.join(removed.select("source", "type").distinct(), ["source", "type"], "left_anti")


def _manual_span(hit: Column) -> Column:
    start, end, rule = hit.start, hit.end, hit.rule
    return F.struct(
        F.concat_ws("_", F.lit("MANUAL"), rule.type, start.cast("string"), end.cast("string")).alias("entity_id"),
        rule.type.alias("type"),
        start.alias("start"),
        end.alias("end"),
        rule.source.alias("source"),
        F.lit(MANUAL_RULE).alias("rule_id"),
        F.lit(None).cast("string").alias("region"),
        F.lit(1.0).alias("confidence"),
        F.lit(MANUAL_BASIS).alias("confidence_basis"),
        F.lit("universal").alias("detector_source"),
        F.lit(MANUAL_PRIORITY).alias("priority"),
        F.lit(None).cast("string").alias("replacement"),
    )


def manual_spans(df: DataFrame, rules: DataFrame, id_cols: Sequence[str], text_col: str = "clean_text",
                 strategy: str = "join") -> DataFrame:
    """Add ``manual``: ``array<struct<ord, span>>``, one entry per rule and occurrence."""
    numbered = dedupe_rules(rules)
    if "ord" not in numbered.columns:
        numbered = numbered.withColumn("ord", F.lit(0))
    with_rules = attach_rules(df, numbered, id_cols, text_col, strategy)
    ordered = F.transform(
        F.array_sort(
            F.transform(RULES, lambda r: F.struct(r.ord.alias("ord"), r.source.alias("source"), r.type.alias("type")))
        ),
        lambda r, i: F.struct(i.alias("ord"), r.source.alias("source"), r.type.alias("type")),
    )
    hits = F.transform(
        literal_hits(F.col(text_col), ordered),
        lambda h: F.struct(h.rule.ord.alias("ord"), _manual_span(h).alias("span")),
    )
    return settle(with_rules, "manual", hits).drop(RULES)


def merge_spans(base: Column, manual: Column) -> Column:
    """Resolve detected and manual spans together; on equal terms a detected span comes first."""
    keys = F.concat(
        F.transform(base, lambda s, i: sort_key(s.start, s.end, s.priority, i, s)),
        F.transform(
            manual, lambda m: sort_key(m.span.start, m.span.end, m.span.priority, m.ord + _FIRST_MANUAL, m.span)
        ),
    )
    return F.transform(sweep(keys), lambda k: k.payload)


def with_user_rules(masked: DataFrame, rules: DataFrame, id_cols: Sequence[str], mode: str = "tag",
                    strategy: str = "join") -> DataFrame:
    """Add user rules to a masking result: merge spans, fill in replacements, rewrite the text.

    ``strategy`` is that of :func:`cloakwork.operators.literals.attach_rules`.
    """
    df = manual_spans(masked, rules, id_cols, strategy=strategy)
    merged = reuse("merged", lambda: merge_spans(F.col("spans"), F.col("manual")))
    df = settle(df, "spans", merged).drop("manual")
    df = settle(df, "spans", reuse(("filled", mode), lambda: fill_replacements(F.col("spans"), mode)))
    return mask_text(df)
