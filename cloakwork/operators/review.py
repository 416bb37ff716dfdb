"""Review of detections: filters, grouping, counts and switches.  Works on the long span table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.catalogue import MANUAL_RULE
from cloakwork.functions.arrays import let, lookup
from cloakwork.operators.literals import join_same
from cloakwork.operators.rewrite import mask_text, required
from cloakwork.operators.settle import settle


def entity_id(type_: Column, start: Column, end: Column, given: Column | None = None) -> Column:
    """The id of a span: the given one, else ``TYPE_start_end``."""
    made = F.concat_ws("_", type_, start.cast("string"), end.cast("string"))
    return made if given is None else F.coalesce(given, made)


def filter_spans(spans: DataFrame, type_: str = "ALL", region: str = "ALL") -> DataFrame:
    """Keep one type and/or region; ``ALL`` keeps everything, region ``""`` keeps spans without a region."""
    if type_ != "ALL":
        spans = spans.where(F.col("type") == type_)
    if region != "ALL":
        spans = spans.where(F.coalesce(F.col("region"), F.lit("")) == region)
    return spans


def present_types(spans: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    return spans.select(*id_cols, "type").distinct()


def present_regions(spans: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    return spans.where(F.col("region").isNotNull()).select(*id_cols, "region").distinct()


DOC = "_cw_doc"


def _by_doc(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """The ids as one struct to join on: structs of nulls are equal, so documents without an id are not lost."""
    return df.withColumn(DOC, F.struct(*id_cols) if id_cols else F.struct(F.lit(0).alias("all")))


def _marks(rows: DataFrame, id_cols: Sequence[str], *more: str) -> DataFrame:
    """Distinct ``_cw_doc, entity_id`` and more columns."""
    return _by_doc(rows, id_cols).select(DOC, "entity_id", *more).distinct()


def review_groups(spans: DataFrame, id_cols: Sequence[str], disabled: DataFrame | None = None) -> DataFrame:
    """Groups of equal values of a type, per document: count, first position, heading, all switched off?

    Order by ``first_start`` for first-seen order.  The members of a group are the span rows with
    its key, so nothing is collected; the aggregation is partial before the shuffle.
    """
    off = F.lit(False)
    if disabled is not None:
        marks = _marks(disabled, id_cols).withColumn("_off", F.lit(True))
        spans = _by_doc(spans, id_cols).join(marks, [DOC, "entity_id"], "left")
        off = F.coalesce(F.col("_off"), F.lit(False))
    return spans.groupBy(*id_cols, "type", "source").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("start").alias("first_start"),
        F.coalesce(F.min_by("region", "start"), F.lit("Global")).alias("heading"),
        F.bool_and(off).alias("all_disabled"),
    )


def frequencies(spans: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """How often each (type, source) occurs."""
    return spans.groupBy(*id_cols, "type", "source").agg(F.count(F.lit(1)).alias("n"))


def total_detections(spans: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """Detections of a long span table; documents without any have no row here (see :func:`detections_per_document`)."""
    return spans.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("detections"))


def detections_per_document(masked: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Detections of every document, also where there are none.  No shuffle."""
    return masked.select(*id_cols, F.coalesce(F.array_size("spans"), F.lit(0)).cast("bigint").alias("detections"))


def toggle_local(disabled: DataFrame, requests: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Flip single spans: the symmetric difference of the switched-off spans and the requests."""
    key = [*id_cols, "entity_id"]
    both = disabled.select(*key).distinct().withColumn("_n", F.lit(1)).unionByName(
        requests.select(*key).distinct().withColumn("_n", F.lit(1))
    )
    return both.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1).drop("_n")


def toggle_everywhere(spans: DataFrame, disabled: DataFrame, requests: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Flip every span with the source of a requested one.

    The requested span's current state decides; manual spans are left alone (see
    :func:`removed_by_requests`).  Requests on one source of a document must agree: if one finds its span on and another
    finds its span off, their order would decide, and the query fails (:func:`switch_sequence` takes an order).
    """
    off = _marks(disabled, id_cols).withColumn("_off", F.lit(True))
    detected = _by_doc(spans.where(F.col("rule_id") != MANUAL_RULE), id_cols).select(DOC, "entity_id", "source")
    states = (
        _marks(requests, id_cols)
        .join(detected, [DOC, "entity_id"])
        .join(off, [DOC, "entity_id"], "left")
        .groupBy(DOC, "source")
        .agg(F.min(F.col("_off").isNull()).alias("low"), F.max(F.col("_off").isNull()).alias("high"))
    )
    refuse = F.raise_error(F.lit("requests on one source disagree: their order would decide")).cast("boolean")
    targets = states.select(DOC, "source", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(refuse).alias("_switch_off"))
    affected = detected.join(targets, [DOC, "source"]).select(DOC, "entity_id", "_switch_off")
    return (
        off.join(affected, [DOC, "entity_id"], "full_outer")
        .where(F.coalesce(F.col("_switch_off"), F.lit(True)))
        .select(f"{DOC}.*", "entity_id")
        .distinct()
    )


def removed_by_requests(spans: DataFrame, requests: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """User rules that a global switch on one of their (manual) spans removes: ``(*id_cols, source, type)``."""
    manual = _by_doc(spans.where(F.col("rule_id") == MANUAL_RULE), id_cols)
    return manual.join(_marks(requests, id_cols), [DOC, "entity_id"], "left_semi").select(*id_cols, "source", "type").distinct()


def switch_everywhere(spans: DataFrame, disabled: DataFrame, rules: DataFrame, requests: DataFrame,
                      id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both branches of a global switch: the spans switched off afterwards, and the user rules left.

    A request on a detected span flips its value; one on a manual span removes that user rule, in its
    document if the rules carry ids, else everywhere.  ``rules``: ``source, type`` and perhaps ids.
    """
    return toggle_everywhere(spans, disabled, requests, id_cols), _rules_left(spans, rules, requests, id_cols)


def _rules_left(spans: DataFrame, rules: DataFrame, requests: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    scope = [c for c in id_cols if c in rules.columns]
    gone = _by_doc(removed_by_requests(spans, requests, id_cols), scope).select(DOC, "source", "type").distinct()
    return _by_doc(rules, scope).join(gone, [DOC, "source", "type"], "left_anti").drop(DOC)


def switch_sequence(spans: DataFrame, disabled: DataFrame, rules: DataFrame, log: DataFrame,
                    id_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Requests one after another: the spans switched off after the last one, and the user rules left.

    ``log``: ids, ``entity_id``, ``seq`` (the order) and ``everywhere``.  A request everywhere flips all detected spans of its
    span's source by what that span's state is by then, or removes the user rule of a manual span; any other flips its
    span alone.  Only requests on the same source of a document meet, so each (document, source) is worked out by itself, in any
    number of tasks.  Two of them with the same ``seq``, or one without, fail the query.

    No request is replayed.  After a request everywhere all spans of the source are alike, so the state it leaves is the
    negation of the one before, once more negated by each single flip of its own span in between: a parity,
    summed over a window.  A span ends with that of the last request everywhere, flipped by the single ones after it.
    """
    known = _by_doc(spans, id_cols).select(DOC, "entity_id", "source", (F.col("rule_id") == MANUAL_RULE).alias("_manual")).distinct()
    rules = _rules_left(spans, rules, log.where("everywhere"), id_cols)
    asked = _by_doc(log, id_cols).select(DOC, "entity_id", "seq", "everywhere").join(known, [DOC, "entity_id"])
    # On a manual span, a request everywhere changes rules, not states.
    asked = asked.where(~(F.col("everywhere") & F.col("_manual")))
    in_order = Window.partitionBy(DOC, "source").orderBy("seq")
    unclear = F.raise_error(F.lit("two requests on one source without an order")).cast(log.schema["seq"].dataType)
    clear = F.col("seq").isNotNull() & ~F.col("seq").eqNullSafe(F.lag("seq").over(in_order))
    asked = asked.withColumn("seq", F.when(clear, F.col("seq")).otherwise(unclear))
    all_ = F.col("everywhere").cast("int")
    # Requests everywhere before this one, itself not counted.
    asked = asked.withColumn("_round", F.sum(all_).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - all_)
    single = asked.where(~F.col("everywhere")).groupBy(DOC, "source", "entity_id", "_round").agg(F.count(F.lit(1)).alias("_flips"))
    off = _marks(disabled, id_cols).withColumn("_off", F.lit(1))
    rounds = asked.where("everywhere").join(single, [DOC, "source", "entity_id", "_round"], "left").join(off, [DOC, "entity_id"], "left")
    first = F.when(F.col("_round") == 0, F.coalesce("_off", F.lit(0))).otherwise(0)
    after = rounds.groupBy(DOC, "source").agg(
        (F.sum(1 + F.coalesce("_flips", F.lit(0)) + first) % 2).alias("_state"), F.count(F.lit(1)).alias("_rounds")
    )
    ends = known.join(after, [DOC, "source"], "left").withColumn("_rounds", F.when(F.col("_manual"), 0).otherwise(F.coalesce("_rounds", F.lit(0))))
    # A manual span takes part in no round; all its single flips count.
    of_round = F.when(F.col("_manual"), 0).otherwise(F.col("_round"))
    late = single.join(known, [DOC, "source", "entity_id"]).withColumn("_rounds", of_round).groupBy(DOC, "entity_id", "_rounds").agg(F.sum("_flips").alias("_late"))
    ends = ends.join(late, [DOC, "entity_id", "_rounds"], "left").join(off, [DOC, "entity_id"], "left")
    base = F.when(F.col("_rounds") > 0, F.col("_state")).otherwise(F.coalesce("_off", F.lit(0)))
    here = ends.where((base + F.coalesce("_late", F.lit(0))) % 2 == 1).select(DOC, "entity_id")
    # What is switched off without being a span stays as it is.
    others = off.select(DOC, "entity_id").join(known, [DOC, "entity_id"], "left_anti")
    return here.unionByName(others).select(f"{DOC}.*", "entity_id"), rules


def apply_switches(masked: DataFrame, disabled: DataFrame, id_cols: Sequence[str], text_col: str = "clean_text") -> DataFrame:
    """Mark switched-off spans and rewrite the text; a switched-off span shows its source.

    ``text_col`` is the text that the spans refer to, for imported pairs the one they were applied to.  Null ids are equal.
    """
    per_doc = disabled.groupBy(*id_cols).agg(F.collect_set("entity_id").alias("_off"))
    df = join_same(masked, per_doc, id_cols)
    ids = F.transform("spans", lambda s: s.entity_id)
    entries = F.transform("_off", lambda e: F.struct(e.alias("k"), F.lit(True).alias("v")))
    marked = F.when(
        F.size("_off") > 0,
        let(
            lookup(ids, entries),
            lambda off: F.transform(
                "spans", lambda s, i: s.withField("disabled", F.coalesce(F.get(off, i), F.lit(False)))
            ),
        ),
    ).otherwise(F.transform("spans", lambda s: s.withField("disabled", F.lit(False))))
    df = settle(df, "spans", marked).drop("_off")
    return mask_text(df, text_col, value=_switched)


def _switched(span: Column) -> Column:
    return F.when(span.disabled, span.source).otherwise(required(span))
