"""Overlap resolution.

Spans are visited by (start, end descending, priority descending, catalogue order).  A span
that overlaps nothing accepted is accepted; one that overlaps is accepted only if it is
strictly stronger than everything it overlaps, which is then evicted for good.

Accepted spans are disjoint and sorted by start, so a new span can overlap the last accepted
one only: one pass with one span of state is enough.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.arrays import let, scan

BLOCK = 65536
FEW = 32  # lists up to this length are swept by a fold that copies its state


def sort_key(start: Column, end: Column, priority: Column, ord_: Column, payload: Column) -> Column:
    """A struct whose natural order is the visiting order."""
    return F.struct(
        start.alias("start"),
        (-end).alias("neg_end"),
        (-priority).alias("neg_priority"),
        ord_.alias("ord"),
        payload.alias("payload"),
    )


def sweep(keys: Column) -> Column:
    """Resolve an array of :func:`sort_key` structs (any order); returns survivors sorted by start."""

    def run(items: Column, light: Column) -> Column:
        nothing = F.get(F.slice(light, 1, 0), F.lit(0))
        states = scan(
            light,
            F.struct(nothing.alias("head"), F.lit(False).alias("taken")),
            lambda st, x: F.when(
                st["head"].isNull() | (x.start >= -st["head"].neg_end) | (x.neg_priority < st["head"].neg_priority),
                F.struct(x.alias("head"), F.lit(True).alias("taken")),
            ).otherwise(F.struct(st["head"].alias("head"), F.lit(False).alias("taken"))),
        )
        taken = F.transform(F.filter(states, lambda s: s.taken), lambda s: s["head"])
        kept = let(
            taken,
            lambda t: F.filter(
                t, lambda x, i: F.coalesce(F.get(t, i + 1).start >= -x.neg_end, F.lit(True))
            ),
        )
        return F.transform(kept, lambda x: F.get(items, x["at"]))

    def numbers(items: Column) -> Column:
        """What the fold looks at; the payload stays behind."""
        return F.transform(
            items,
            lambda x, i: F.struct(
                x.start.alias("start"), x.neg_end.alias("neg_end"), x.neg_priority.alias("neg_priority"), i.alias("at")
            ),
        )

    def few(items: Column) -> Column:
        """The same fold for a short list: its state is the places of the spans accepted by then, the last one evicted where it must be."""

        def step(taken: Column, i: Column) -> Column:
            x, head = F.get(items, i), F.get(items, F.get(taken, F.size(taken) - 1))
            free, stronger = x.start >= -head.neg_end, x.neg_priority < head.neg_priority
            return (
                F.when((F.size(taken) == 0) | free | (free.isNull() & stronger), F.array_append(taken, i))
                .when(stronger, F.array_append(F.slice(taken, F.lit(1), F.size(taken) - 1), i))
                .otherwise(taken)
            )

        kept = F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), F.expr("CAST(array() AS ARRAY<INT>)"), step)
        return F.transform(kept, lambda i: F.get(items, i))

    return let(
        F.sort_array(keys),
        lambda k: F.when(F.size(k) < 2, k).when(F.size(k) <= FEW, few(k)).otherwise(let(numbers(k), lambda n: run(k, n))),
    )


def resolve_overlaps(spans: DataFrame, id_cols: list[str], block: int = BLOCK) -> DataFrame:
    """Resolve a long span table ``(*id_cols, ord, start, end, priority, ...)``; null ids are equal.

    A document is cut into blocks of positions, so one that holds most of the spans is still spread.  The
    only thing that a block needs to know of those before it is the last accepted span, if it reaches into the block:

    1. each block is summed up as a function from that span to the last accepted one at the block's end;
    2. the summaries of a document are composed in order, which gives every block the span that enters it, and
       tells whether its own last span is evicted later on;
    3. blocks are swept, each from what enters it.

    Spans are dealt out once, and summaries and entries once each.  Blocks that nothing enters, as those of short
    documents, have neither.  Tasks pass through sorted rows and hold one block at a time, never a document or an
    island of overlapping spans.
    """
    key = F.struct(*id_cols)  # structs of nulls are equal
    dealt = spans.withColumns({"_key": key, "_block": F.floor(F.col("start") / block)}).repartition("_key", "_block")
    order = ["_key", "_block", F.col("start"), F.col("end").desc(), F.col("priority").desc(), F.col("ord")]
    place = [dealt.schema["_key"], dealt.schema["_block"]]  # with the same nulls allowed, the join below needs no cast and no exchange of spans
    summary = T.StructType([*place, *(T.StructField(n, T.ArrayType(T.LongType())) for n in _SUMMARY)])
    entry = T.StructType([*place, *(T.StructField(n, T.LongType()) for n in ("_end", "_priority")), T.StructField("_evicted", T.BooleanType())])
    summed = dealt.sortWithinPartitions(*order).mapInArrow(_summaries(id_cols, block), summary)
    entries = summed.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(_compose(id_cols), entry)
    swept = dealt.join(entries, ["_key", "_block"], "left").select(*dealt.columns, "_end", "_priority", "_evicted")
    return swept.sortWithinPartitions(*order).mapInArrow(_sweep_blocks(id_cols, spans.columns), spans.schema)


_SUMMARY = ("record_priority", "record_place", "record_start", "run_place", "run_start", "run_end", "run_priority")


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first, whether it differs from the one before; nulls are equal."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for column in columns:
        if pa.types.is_struct(column.type):
            out |= _changes(column.flatten())
            continue
        here, before = column[1:], column[:-1]
        out |= pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        out |= pc.xor(pc.is_null(here), pc.is_null(before)).to_numpy(zero_copy_only=False)
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups of equal ``names``, with the places where groups begin and the table ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        columns = [batch.column(n) for n in names]
        turns = np.flatnonzero(_changes(columns)) + 1
        if not len(turns) and len(held) == 1:
            continue
        joint = len(held) > 1 and _changes([pa.concat_arrays([held[-2].column(n)[-1:], batch.column(n)[:1]]) for n in names]).any()
        last = int(turns[-1]) if len(turns) else 0
        if last or joint:
            yield _cut(held[:-1] + [batch.slice(0, last)], names)
            held = [batch.slice(last)]
    if held:
        yield _cut(held, names)


def _cut(batches: list[pa.RecordBatch], names: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    columns = [table.column(n).chunk(0) if table.num_rows else table.column(n).combine_chunks() for n in names]
    return table, np.concatenate([[0], np.flatnonzero(_changes(columns)) + 1, [table.num_rows]])


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _summaries(id_cols: list[str], block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum up blocks that can meet others: all but a first block whose spans end inside it.

    A span that enters decides which span of the block is accepted first: the first one that starts behind it or is
    stronger.  From there on everything follows.  So the block is told by its stronger and stronger spans (``record``), and by
    the last accepted span that follows from each first one, in runs of equal ones (``run``, with its last place).
    """

    def one(start: np.ndarray, end: np.ndarray, priority: np.ndarray) -> list[list[int]]:
        n = len(start)
        after = np.maximum(np.searchsorted(start, end, "left"), np.arange(1, n + 1)).tolist()  # starts behind
        strength, waiting = priority.tolist(), []
        last = [0] * n
        for j in range(n - 1, -1, -1):
            while waiting and strength[waiting[-1]] <= strength[j]:
                waiting.pop()
            follows = min(after[j], waiting[-1] if waiting else n)
            last[j] = last[follows] if follows < n else j
            waiting.append(j)
        records = np.flatnonzero(np.append(True, priority[1:] > np.maximum.accumulate(priority)[:-1]))
        last = np.array(last)
        runs = np.append(np.flatnonzero(last[1:] != last[:-1]), n - 1)
        out = (priority[records], records, start[records], runs, start[runs], end[last[runs]], priority[last[runs]])
        return [x.tolist() for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches, [*id_cols, "_block"]):
            start, end, priority, where = _numbers(table, "start", "end", "priority", "_block")
            rows, columns = [], [[] for _ in _SUMMARY]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if where[a] == 0 and end[a:b].max() <= block:
                    continue
                rows.append(a)
                for column, value in zip(columns, one(start[a:b], end[a:b], priority[a:b]), strict=True):
                    column.append(value)
            key = table.select(["_key", "_block"]).take(pa.array(rows, pa.int64())).combine_chunks()
            arrays = [pa.array(c, pa.list_(pa.int64())) for c in columns]
            for part in pa.Table.from_arrays([*key.columns, *arrays], names=["_key", "_block", *_SUMMARY]).to_batches():
                yield part

    return run


def _compose(id_cols: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Follow the last accepted span through the blocks of a document, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.Array | None = None
        head: tuple[int, int] | None = None  # end and priority of the last accepted span
        own: dict | None = None  # what the block that holds it will be told
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_key")
            turn = _changes([keys if before is None else pa.concat_arrays([before, keys])])
            turn = np.append(True, turn) if before is None else turn
            before = keys[-1:]
            told: list[dict] = []
            for new, row in zip(turn.tolist(), batch.to_pylist(), strict=True):
                if new:
                    told, head, own = [*told, *([own] if own else [])], None, None
                entry = head if head and row["run_start"] and head[0] > row["record_start"][0] else None
                here = {"_key": row["_key"], "_block": row["_block"], "_end": entry and entry[0], "_priority": entry and entry[1], "_evicted": False}
                first = 0
                if entry:
                    stronger = bisect_right(row["record_priority"], entry[1])
                    behind = bisect_left(row["run_start"], entry[0])
                    if stronger < len(row["record_place"]):
                        first = min(behind, bisect_left(row["run_place"], row["record_place"][stronger]))
                        own["_evicted"] |= row["record_start"][stronger] < entry[0]
                    else:
                        first = behind
                if first < len(row["run_end"]):
                    told += [own] if own else []
                    head, own = (row["run_end"][first], row["run_priority"][first]), here
                else:
                    told.append(here)
            yield _entries(told, batch.schema.field("_key").type)
        if own:
            yield _entries([own], before.type)

    return run


def _entries(told: list[dict], key: pa.DataType) -> pa.RecordBatch:
    told = [t for t in told if t["_end"] is not None or t["_evicted"]]
    schema = pa.schema([("_key", key), ("_block", pa.int64()), ("_end", pa.int64()), ("_priority", pa.int64()), ("_evicted", pa.bool_())])
    return pa.RecordBatch.from_pylist(told, schema)


def _sweep_blocks(id_cols: list[str], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches, [*id_cols, "_block"]):
            start, end, priority = (x.tolist() for x in _numbers(table, "start", "end", "priority"))
            enters, strong, evicted = (table.column(n).to_pylist() for n in ("_end", "_priority", "_evicted"))
            kept: list[int] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine, reach, best = None, enters[a], strong[a]
                for i in range(a, b):
                    free = reach is None or start[i] >= reach
                    if free or priority[i] > best:
                        if mine is not None and free:
                            kept.append(mine)
                        mine, reach, best = i, end[i], priority[i]
                if mine is not None and not evicted[a]:
                    kept.append(mine)
            yield from table.select(columns).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

    return run


# Workers get these functions by value, so they need not be able to import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
