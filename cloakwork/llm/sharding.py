"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a small versioned
map says which shard holds each slot.  The first map deals slots, largest first, to the shard with
the fewest bytes.  Later maps are edits of the one before: slots move only to shards that lack
bytes, so most records stay where they are.

The map has one row per slot, whatever the data, so it is sorted in one row and broadcast.

Defined cases: a null text has no bytes; a null id is hashed like any other; repeated rows are placed each
by itself, in the same slot; an empty table gives an empty result (and a map that deals empty slots
out in turn).  Only the id and text columns are read, so clashing names of others do not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import shared_dir, table, text_or_empty

SLOTS = 4096
OVERHEAD = 8  # bytes of a record besides its text


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, virtual_slot`` per row."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, rows`` for every slot, also the empty ones."""
    have = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(have, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def _deal(sizes: DataFrame, start: str, step: str, version: int) -> DataFrame:
    """Fold a SQL step over all slots, largest first, in one row; ``step`` turns (s, x) into the next state."""
    one = sizes.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "bytes", "shard"))).alias("slots")
    )
    folded = one.select(F.expr(f"aggregate(slots, {start}, (s, x) -> {step})").alias("s"))
    return folded.select(F.explode("s.placed").alias("p")).select(
        "p.virtual_slot", "p.shard", F.lit(version).alias("version")
    )


_NO_SLOTS = "CAST(array() AS array<struct<virtual_slot:int,shard:int>>)"


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: ``virtual_slot, shard, version``.  Slots, largest first, go to the lightest shard."""
    lightest = "CAST(array_position(s.loads, array_min(s.loads)) AS INT) - 1"
    # An empty slot weighs 1, so that empty slots are dealt in turn as well.
    step = f"""named_struct(
 'loads', transform(s.loads, (l, i) -> IF(i = {lightest}, l + greatest(x.bytes, 1L), l)),
 'placed', concat(s.placed, array(named_struct('virtual_slot', x.virtual_slot, 'shard', {lightest}))))"""
    start = f"named_struct('loads', array_repeat(0L, {shards}), 'placed', {_NO_SLOTS})"
    return _deal(sizes.withColumn("shard", F.lit(0)), start, step, 1)


def edited_map(old: DataFrame, sizes: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version: slots, largest first, leave a shard above the mean for the lightest shard, if that stays below the mean.

    With more shards than before, the new ones start empty, so they take most of what moves.
    """
    loads = "transform(sequence(0, {n} - 1), i -> aggregate(filter(slots, y -> y.shard = i), 0L, (a, y) -> a + y.bytes))".format(n=shards)
    mean = f"(aggregate(slots, 0L, (a, y) -> a + y.bytes) / {shards})"
    to = "CAST(array_position(s.loads, array_min(s.loads)) AS INT) - 1"
    moves = f"(s.loads[x.shard] > {mean} AND x.bytes > 0 AND array_min(s.loads) + x.bytes <= {mean})"
    step = f"""named_struct(
 'loads', IF({moves}, transform(s.loads, (l, i) -> CASE WHEN i = {to} THEN l + x.bytes WHEN i = x.shard THEN l - x.bytes ELSE l END), s.loads),
 'placed', concat(s.placed, array(named_struct('virtual_slot', x.virtual_slot, 'shard', IF({moves}, {to}, x.shard)))))"""
    start = f"named_struct('loads', {loads}, 'placed', {_NO_SLOTS})"
    return _deal(sizes.join(old.select("virtual_slot", "shard"), "virtual_slot"), start, step, version)


def store_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version of the map to a folder that the caller names; older versions stay."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    every = spark.read.schema("virtual_slot INT, shard INT, version INT").parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with ``shard`` and ``slot``, a gapless position in the shard: slots in order, rows by id inside.

    Positions come from counts per slot and ranks inside slots, so no task ranks a whole shard.
    """
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("rows").over(in_shard)
    starts = sizes.join(F.broadcast(slot_map), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("start")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(F.broadcast(starts), "virtual_slot").select(
        *rows.columns, "shard", (F.col("start") + F.col("rank") - 1).cast("bigint").alias("slot")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes; the map is stored as version 1 in the shared folder."""
    rows = records(table(spark, sf_dir, "documents"))
    folder = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sizes = slot_bytes(rows)
    store_map(first_map(sizes, 24), folder)
    out = placed(rows, load_map(spark, folder), sizes)
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


ORACLE: dict[str, str] = {}  # crc32 is not at hand in SQL
QUERIES = {"op6_sharding": op6_sharding}
