"""Jobs over a whole corpus: standard rule lists and pseudonyms that hold across documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.arrays import let, lookup
from cloakwork.functions.replacements import replacement
from cloakwork.operators.literals import join_same
from cloakwork.operators.pairs import apply_pairs
from cloakwork.operators.rewrite import mask_text
from cloakwork.operators.settle import ensure_checkpoint_dir, settle, shared_checkpoint
from cloakwork.sources.dictionary import committed_versions, read_dictionary, write_version
from cloakwork.plans.masking import explode_spans

HOT_SHARE = 1000
SALTS = 64


def apply_rule_list(df: DataFrame, pairs: DataFrame, id_cols: Sequence[str], text_col: str = "text",
                    direction: str = "forward", strategy: str = "join") -> DataFrame:
    """Apply one list of pairs to every document (see :func:`cloakwork.operators.pairs.apply_pairs`)."""
    scoped = [c for c in pairs.columns if c in id_cols]
    return apply_pairs(df, pairs.drop(*scoped), id_cols, direction, text_col, strategy)


def rule_list_summary(applied: DataFrame) -> DataFrame:
    """Corpus totals of :func:`apply_rule_list`."""
    return applied.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("applied").alias("applied"),
        F.count_if(F.col("applied") > 0).alias("documents_changed"),
    )


def corpus_numbers(spans: DataFrame, id_col: str, checkpoint_dir: str | None = None) -> DataFrame:
    """Number the distinct values of each type over the whole corpus: ``(type, region_key, source, n, uses)``.

    Numbers follow the first appearance by (document, position).  There is no global window: the
    keys are sorted by range, counted per partition, and offset by the counts of the partitions
    before.  The sorted keys are checkpointed, as both passes must see the same partitions.
    """
    ensure_checkpoint_dir(spans, checkpoint_dir)
    keys = spans.groupBy("type", F.coalesce("region", F.lit("-")).alias("region_key"), "source").agg(
        F.min(F.struct(F.col(id_col).alias("doc"), F.col("start").alias("start"))).alias("first"),
        F.count(F.lit(1)).alias("uses"),
    )
    placed = (
        keys.repartitionByRange("type", "first")
        .sortWithinPartitions("type", "first")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    # One row per partition and type: bounded by the partition count, not by the data.
    parts = placed.groupBy("type", "_part").agg(F.min("_row").alias("_first_row"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "type", "_part", "_first_row", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), ["type", "_part"]).select(
        "type", "region_key", "source",
        (F.col("_offset") + F.col("_row") - F.col("_first_row") + 1).alias("n"),
        "uses",
    )


VALUE = ("type", "region_key", "source")
TEXT_KEY = "_cw_text_key"


def extend_dictionary(spans: DataFrame, id_col: str, path: str, checkpoint_dir: str | None = None) -> DataFrame:
    """Give the values of ``spans`` that the stored dictionary does not know yet the next numbers of their types, and store them
    as a new version; returns the dictionary with them.

    Numbers never change once they are stored.  The known values are left out first, so only new ones are numbered, in order of
    first appearance, after the largest number of their type.  A run that finds nothing new stores nothing.
    """
    versions = committed_versions(spans.sparkSession, path)
    if not versions:
        new = corpus_numbers(spans, id_col, checkpoint_dir).drop("uses")
    else:
        known = read_dictionary(spans.sparkSession, path)
        region_key = F.coalesce("region", F.lit("-")).alias("region_key")
        fresh = spans.withColumn("region_key", region_key).join(known.select(*VALUE), list(VALUE), "left_anti")
        last = known.groupBy("type").agg(F.max("n").alias("_last"))  # a row per type
        new = corpus_numbers(fresh, id_col, checkpoint_dir).drop("uses").join(F.broadcast(last), "type", "left")
        new = new.select(*VALUE, (F.col("n") + F.coalesce("_last", F.lit(0))).alias("n"))
    new = shared_checkpoint(new, checkpoint_dir)
    if not versions or not new.isEmpty():
        write_version(new, path, max(versions, default=-1) + 1)
    return read_dictionary(spans.sparkSession, path)


def corpus_pseudonyms(detected: DataFrame, id_col: str, mode: str = "tag", checkpoint_dir: str | None = None,
                      dictionary: str | None = None) -> DataFrame:
    """Mask with numbers that hold across documents: equal values get equal replacements everywhere.

    ``detected`` is the result of :func:`cloakwork.plans.masking.detect`; write it out first at
    scale, as its spans are read twice.  With a ``dictionary``, a path, numbers also hold across runs (see
    :func:`extend_dictionary`); without, they count from 1 in each run.

    A document gets the names of the values it holds, matched by value, so null or repeated ids neither lose nor mix
    them; documents without an id are kept apart by their texts.  A span without a name fails the query.
    """
    keyed = detected.withColumn(TEXT_KEY, F.xxhash64("clean_text"))
    key = [id_col, TEXT_KEY]
    spans = explode_spans(keyed.select(*key, "spans"), *key)
    value = list(VALUE)
    if dictionary is None:
        numbers = corpus_numbers(spans, id_col, checkpoint_dir)
    else:
        extended = extend_dictionary(spans, id_col, dictionary, checkpoint_dir)
        region_key = F.coalesce("region", F.lit("-")).alias("region_key")
        uses = spans.groupBy("type", region_key, "source").agg(F.count(F.lit(1)).alias("uses"))
        numbers = extended.join(uses, value)
    numbers = shared_checkpoint(numbers, checkpoint_dir)
    # A value with more than 1/HOT_SHARE of all uses is hot; there are at most HOT_SHARE of them,
    # so the list of hot values is small enough to broadcast.  Their uses are spread over salts.
    total = numbers.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("t")).first()["t"]
    limit = F.lit(max(total // HOT_SHARE, 1000))
    hot = numbers.where(F.col("uses") > limit)
    marked = spans.withColumn("region_key", F.coalesce("region", F.lit("-"))).join(
        F.broadcast(hot.select(*value, F.lit(True).alias("_hot"))), value, "left"
    )
    marked = marked.withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*key, "start"), F.lit(SALTS))).otherwise(F.lit(0))
    )
    copies = F.when(F.col("uses") > limit, F.lit(SALTS)).otherwise(F.lit(1))
    salted = numbers.select(*value, "n", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_salt"))
    named = marked.join(salted.withColumn("_salt", F.col("_salt").cast("bigint")), [*value, "_salt"])
    one = F.struct(
        F.struct(*value).alias("k"), replacement(mode, F.col("type"), F.col("n"), F.col("region"), F.col("source")).alias("v")
    )
    per_doc = named.groupBy(*key).agg(F.collect_set(one).alias("_names"))
    values = F.transform("spans", lambda s: F.struct(
        s.type.alias("type"), F.coalesce(s.region, F.lit("-")).alias("region_key"), s.source.alias("source")))
    given = F.when(
        F.size("spans") > 0,
        let(lookup(values, F.col("_names")),
            lambda names: F.transform("spans", lambda s, i: s.withField("replacement", F.get(names, i)))),
    )
    joined = settle(join_same(keyed, per_doc, key), "spans", given)
    return mask_text(joined.drop("_names", TEXT_KEY))
