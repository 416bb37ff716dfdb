"""Rule pairs: collect them from masking results, apply them forward, or in reverse to restore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.catalogue import IMPORTED_BASIS, MANUAL_RULE
from cloakwork.functions.arrays import let, lookup, scan, sorted_distinct
from cloakwork.functions.text import positions, slice_blocks, trim_space
from cloakwork.operators.literals import RULES, attach_rules, join_same, literal_hits
from cloakwork.operators.overlaps import sort_key, sweep
from cloakwork.operators.rewrite import BLOCKS, mask_text
from cloakwork.operators.settle import settle

PAIR_FIELDS = ("entity_type", "origin", "source", "replacement", "region", "rule_id")
DIRECTIONS = ("forward", "reverse")
# Every tag that masking can write.
TAG = r"\[(?:USER|PERSON|ORG|DOC_ID|EMAIL|PHONE|IP|ADDRESS|CARD|ACCOUNT|IBAN|SWIFT_BIC|DATE)_[0-9]+\]"


def swap_on_export(result_mode: str, import_direction: str | None) -> bool:
    """Pairs are exported swapped only after a reverse import, so that files keep their direction."""
    return result_mode == "imported" and import_direction == "reverse"


def _pair(span: Column, swap: bool) -> Column:
    source, target = (span["replacement"], span["source"]) if swap else (span["source"], span["replacement"])
    return F.struct(
        span["type"].alias("entity_type"),
        F.when(span["rule_id"] == MANUAL_RULE, F.lit("user")).otherwise(F.lit("system")).alias("origin"),
        trim_space(source).alias("source"),
        trim_space(target).alias("replacement"),
        span["region"].alias("region"),
        span["rule_id"].alias("rule_id"),
    )


def collect_pairs(spans: DataFrame, id_cols: Sequence[str] = (), swap: bool = False) -> DataFrame:
    """Distinct pairs of a long span table, over the corpus or per document; blank sides are dropped.

    ``ord`` follows (entity_type, origin, source, replacement) in code point order.  It counts from 0 in
    each document; over the corpus it only grows, as partitions of sorted ranges number their own rows.
    """
    pair = _pair({c: F.col(c) for c in ("type", "rule_id", "source", "replacement", "region")}, swap)
    pairs = spans.select(*id_cols, pair.alias("_p")).select(*id_cols, "_p.*")
    pairs = pairs.where((F.col("source") != "") & (F.col("replacement") != "")).distinct()
    order = ("entity_type", "origin", "source", "replacement", "region", "rule_id")
    if id_cols:
        return pairs.withColumn("ord", (F.row_number().over(Window.partitionBy(*id_cols).orderBy(*order)) - 1).cast("bigint"))
    sorted_ = pairs.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.withColumn("ord", F.monotonically_increasing_id())


def pairs_of_row(spans: Column, swap: bool = False) -> Column:
    """The same inside a document row: a sorted array of distinct pairs.  No shuffle."""
    pairs = F.filter(
        F.transform(spans, lambda s: _pair(s, swap)), lambda p: (p.source != "") & (p.replacement != "")
    )
    return sorted_distinct(pairs)


def user_rules_of(pairs: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """Imported pairs of user origin become user rules."""
    return (
        pairs.where(F.col("origin") == "user")
        .select(*id_cols, "source", F.col("entity_type").alias("type"))
        .dropDuplicates([*id_cols, "source", "type"])
    )


def _imported_span(h: Column, i: Column) -> Column:
    """The span of occurrence ``i``; occurrences are numbered by rule, then position, before overlaps are resolved."""
    r = h.rule
    return F.struct(
        F.concat(F.lit("IMPORTED_"), (i + 1).cast("string")).alias("entity_id"),
        r.type.alias("type"),
        h.start.alias("start"),
        h.end.alias("end"),
        r.source.alias("source"),
        r.rule_id.alias("rule_id"),
        r.region.alias("region"),
        F.lit(1.0).alias("confidence"),
        F.lit(IMPORTED_BASIS).alias("confidence_basis"),
        F.when(r.region.isNull(), F.lit("universal")).otherwise(F.lit("regional")).alias("detector_source"),
        r.priority.alias("priority"),
        r.replacement.alias("replacement"),
        r.ord.alias("ord"),
    )


def apply_pairs(df: DataFrame, pairs: DataFrame, id_cols: Sequence[str], direction: str = "forward",
                text_col: str = "text", strategy: str = "join") -> DataFrame:
    """Replace every occurrence of the pairs' ``from`` side.

    Longer texts win, then user pairs, then list order (column ``ord`` if there is one).  Pairs with
    some of the id columns apply to the documents with those ids only.  Adds ``spans``, ``masked_text``, ``applied``
    (surviving spans) and ``skipped`` (pairs of the document, or of the list, without any occurrence).
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    scope = [c for c in id_cols if c in pairs.columns]
    source, target = ("source", "replacement") if direction == "forward" else ("replacement", "source")
    ord_ = F.col("ord") if "ord" in pairs.columns else F.lit(0)
    rules = pairs.select(
        *scope,
        ord_.cast("bigint").alias("ord"),
        F.col(source).alias("source"),
        F.col(target).alias("replacement"),
        F.col("entity_type").alias("type"),
        "region",
        F.coalesce(F.col("rule_id"), F.concat(F.lit("imported."), F.col("origin"))).alias("rule_id"),
        (F.length(source) * 100 + F.when(F.col("origin") == "user", 1).otherwise(0)).alias("priority"),
    )
    useful = (F.col("source") != "") & (F.col("replacement") != "") & (F.col("source") != F.col("replacement"))
    if scope:
        totals = rules.groupBy(*scope).agg(F.count(F.lit(1)).alias("_total"))
        with_rules = attach_rules(df, rules.where(useful), id_cols, text_col)
        with_rules = join_same(with_rules, totals, scope).withColumn("_total", F.coalesce("_total", F.lit(0)))
    else:
        total = rules.agg(F.count(F.lit(1)).alias("_total"))  # one row
        with_rules = attach_rules(df, rules.where(useful), id_cols, text_col, strategy).crossJoin(F.broadcast(total))
    # Number the rules of a row, in list order, so that ties and counts are well defined.
    ordered = F.transform(F.array_sort(F.col(RULES)), lambda r, i: r.withField("ord", i))
    found = settle(with_rules, "_hits", literal_hits(F.col(text_col), ordered)).drop(RULES)
    keys = F.transform("_hits", lambda h, i: sort_key(h.start, h.end, h.rule.priority, h.rule.ord, _imported_span(h, i)))
    matched = F.size(F.array_distinct(F.transform("_hits", lambda h: h.rule.ord)))
    found = (
        settle(found, "spans", F.transform(sweep(keys), lambda k: k.payload.dropFields("ord")))
        .withColumn("skipped", (F.col("_total") - matched).cast("bigint"))
        .withColumn("applied", F.size("spans").cast("bigint"))
    )
    return mask_text(found.drop("_hits", "_total"), text_col=text_col)


def restore_tags(df: DataFrame, mapping: DataFrame, id_cols: Sequence[str], text_col: str = "masked_text",
                 out_col: str = "restored_text", null_ids: bool = True) -> DataFrame:
    """Put the sources back for ``[TYPE_n]`` tags, from a mapping table scoped by document.

    The mapping is grouped by document first, so documents and mapping meet in one equi-join (or
    none, if both are bucketed by the id and ``null_ids`` is off).  Tags cannot overlap, so one pass finds them all.  Null
    ids are equal, unless ``null_ids`` is off.  Where documents share an id and their mappings disagree on a tag, the query
    fails rather than put in the value of another document.
    """
    pair = F.struct(F.col("replacement").alias("k"), F.col("source").alias("v"))
    per_doc = (
        mapping.where(F.col("replacement") != F.col("source"))
        .groupBy(*id_cols)
        .agg(F.collect_set(pair).alias("_pairs"))
    )
    clear = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["k"]))) == F.size("_pairs")
    refuse = F.raise_error(F.lit("one tag stands for two sources: the ids of the mapping repeat"))
    per_doc = per_doc.withColumn("_pairs", F.when(clear, F.col("_pairs")).otherwise(refuse.cast(per_doc.schema["_pairs"].dataType)))
    joined = join_same(df, per_doc, id_cols, null_ids)
    text = F.col(text_col)
    joined = joined.withColumn(
        "_tags", F.when(F.size("_pairs") > 0, F.regexp_extract_all(text, F.lit(TAG), F.lit(0)))
    )
    joined = joined.withColumn(
        "_at", F.when(F.size("_tags") > 0, positions(F.col("_tags"), F.transform(F.split(text, TAG, -1), F.length)))
    )
    known = F.when(
        F.size("_at") > 0,
        let(
            lookup(F.transform("_at", lambda p: p.source), F.col("_pairs")),
            lambda values: F.filter(
                F.transform("_at", lambda p, i: p.withField("replacement", F.get(values, i))),
                lambda p: p.replacement.isNotNull(),
            ),
        ),
    )
    joined = settle(joined, "_known", known).drop("_pairs", "_tags", "_at")
    return mask_text(joined, text_col=text_col, spans_col="_known", out_col=out_col).drop("_known")


def _shifted(records: Column) -> Column:
    """Where each replacement stands in the masked text: its place in the original, moved by what those before it changed.

    ``records`` are distinct, by start.  Two that overlap cannot be of one text, so they fail the query.
    """
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("source"), F.lit("").alias("replacement"), F.lit(0).alias("past"))
    refuse = F.raise_error(F.lit("spans of the mapping overlap: its ids repeat")).cast("int")

    def step(st: Column, r: Column) -> Column:
        start = F.when(r.start >= st.past, st.end + r.start - st.past).otherwise(refuse)
        return F.struct(
            start.alias("start"), (start + F.length(r.replacement)).alias("end"), r.source.alias("source"),
            r.replacement.alias("replacement"), r.end.alias("past"),
        )

    return scan(records, zero, step)


def _checked_source(span: Column) -> Column:
    """The source of a span, where its replacement is what the text has there."""
    there = slice_blocks(F.col(BLOCKS), span.start, span.end) == span.replacement
    refuse = F.raise_error(F.lit("the text does not have the replacement that the mapping names")).cast("string")
    return F.when(there, span.source).otherwise(refuse)


def restore_positions(df: DataFrame, mapping: DataFrame, id_cols: Sequence[str], text_col: str = "masked_text",
                      out_col: str = "restored_text", null_ids: bool = True) -> DataFrame:
    """Put the sources back by position, from a mapping table scoped by document.

    Replacements are not looked up, so this restores synthetic values too, which repeat, and texts that held
    something like ``[EMAIL_1]`` before.  The text must be the masking result as it was written: one that differs at
    a replacement fails the query, and so does a mapping whose spans overlap, as where documents share an id.  Records with
    ``enabled`` false show their source in the text and are left out.  Null ids are equal, unless
    ``null_ids`` is off.

    Mapping and documents meet in one equi-join, or in none if both are bucketed by the id and ``null_ids`` is off.
    """
    place = F.col("position")
    kept = mapping.where(F.coalesce(F.col("enabled"), F.lit(True))) if "enabled" in mapping.columns else mapping
    record = F.struct(place["start"].cast("int").alias("start"), place["end"].cast("int").alias("end"), "source", "replacement")
    per_doc = kept.groupBy(*id_cols).agg(F.array_sort(F.collect_set(record)).alias("_records"))
    joined = settle(join_same(df, per_doc, id_cols, null_ids), "_known", F.when(F.size("_records") > 0, _shifted(F.col("_records"))))
    return mask_text(joined.drop("_records"), text_col, "_known", out_col, _checked_source).drop("_known")
