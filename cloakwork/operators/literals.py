"""Literal rules: give every document the rules that may apply to it, then find them in place.

The search itself runs inside the row (:func:`literal_hits`).  What differs is how a document
gets its rules:

* rules that carry ids of documents: one equi-join on those ids, where nulls are equal;
* a list for the whole corpus, strategy ``join``: an equi-join on grams of bytes (:func:`_by_gram`), for lists of any
  length;
* a list for the whole corpus, strategy ``constant``: a constant of the plan, for lists that the
  caller knows to be short; a list beyond :data:`CONSTANT_RULES` is refused.

The caller chooses; the result is the same.  Rows that share an id may be given rules of each
other, which changes nothing, as every rule is searched for in the text itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.text import occurrences
from cloakwork.operators.settle import shared_checkpoint

STRATEGIES = ("join", "constant")
CONSTANT_RULES = 10_000
GRAM = 8  # bytes; a shorter literal is a gram by itself
BITS_PER_GRAM = 16
MAX_WORDS = 1 << 23  # 64-bit words of the largest bit table: 64 MB; beyond 32 million grams it only lets more of them through
WORDS_PER_ROW = 1 << 13
HOT_SHARE, HOT_LEAST, SALTS = 1000, 10_000, 64

RULES, TEXT_KEY = "_cw_rules", "_cw_text_key"


def literal_hits(text: Column, rules: Column) -> Column:
    """All occurrences of all rules: ``array<struct<rule, start, end>>``; each rule by itself does not overlap."""
    return F.flatten(
        F.transform(
            rules,
            lambda r: F.transform(
                occurrences(text, r.source),
                lambda o: F.struct(r.alias("rule"), o.start.alias("start"), o.end.alias("end")),
            ),
        )
    )


def _constant(rows: list, schema: T.StructType) -> Column:
    data = json.dumps([{f.name: r[f.name] for f in schema.fields if r[f.name] is not None} for r in rows], ensure_ascii=False)
    return F.from_json(F.lit(data), T.ArrayType(schema))


def join_same(df: DataFrame, right: DataFrame, id_cols: Sequence[str], null_ids: bool = True) -> DataFrame:
    """Left join on the id columns, where a null equals a null.  Without ``null_ids`` none does, and buckets by the ids are used."""
    keys = [f"_cw_key_{i}" for i in range(len(id_cols))]
    renamed = right.withColumnsRenamed(dict(zip(id_cols, keys, strict=True)))
    equal = Column.eqNullSafe if null_ids else Column.__eq__
    same = reduce(and_, [equal(F.col(c), F.col(k)) for c, k in zip(id_cols, keys, strict=True)])
    return df.join(renamed, same, "left").drop(*keys)


def attach_rules(df: DataFrame, rules: DataFrame, id_cols: Sequence[str], text_col: str,
                 strategy: str = "join") -> DataFrame:
    """Add ``_cw_rules``: the rules (structs of the columns of ``rules``) that may occur in the text.

    ``rules`` needs a string column ``source``.  If it has some of the id columns, a rule is for the
    documents with those ids only; ``strategy`` is for lists without ids.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    scope = [c for c in id_cols if c in rules.columns]
    fields = [c for c in rules.columns if c not in scope]
    packed = F.struct(*fields)
    if scope:
        per_doc = rules.groupBy(*scope).agg(F.collect_list(packed).alias(RULES))
        return _with_empty(join_same(df, per_doc, scope), rules, fields)
    if strategy == "constant":
        schema = T.StructType([rules.schema[f] for f in fields])
        rows = rules.select(*fields).limit(CONSTANT_RULES + 1).collect()
        if len(rows) > CONSTANT_RULES:
            raise ValueError(f"a list of more than {CONSTANT_RULES} rules is too long for a constant: use strategy join")
        return df.withColumn(RULES, _constant(rows, schema))
    # Equal rules of the list stay apart by their number.
    nth = F.row_number().over(Window.partitionBy(*fields).orderBy(F.lit(0)))
    key = [*id_cols, TEXT_KEY]  # the text's hash keeps documents without an id apart
    keyed = df.withColumn(TEXT_KEY, F.xxhash64(text_col))
    found = _by_gram(keyed, rules.select(*fields).withColumn("_nth", nth), key, text_col)
    per_doc = found.groupBy(*key).agg(F.collect_set(F.struct(*fields, "_nth")).alias(RULES))
    per_doc = per_doc.withColumn(RULES, F.transform(RULES, lambda r: r.dropFields("_nth")))
    return _with_empty(join_same(keyed, per_doc, key), rules, fields).drop(TEXT_KEY)


def _with_empty(df: DataFrame, rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    kind = T.ArrayType(T.StructType([rules.schema[f] for f in fields]))
    return df.withColumn(RULES, F.coalesce(F.col(RULES), F.array()).cast(kind))


def _gram_reader(sizes: Sequence[int]) -> Callable[..., Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """A function that gives the distinct grams of each row of a column of bytes: size, rows, values.  Workers need no import for it.

    A value is the gram itself, its bytes as one number.  An occurrence of a literal in a text is one of their UTF-8 bytes
    too, so a text that holds the literal holds its grams.  ``keep`` tells from size, rows and values which to give.
    """
    chunk = 1 << 22  # bytes at a time

    def read(column: pa.Array, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + chunk, "right")) - 1)
            part = data[ends[at] : ends[to]].astype(np.uint64)
            rows = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
            values = part
            for size in range(1, max(sizes, default=0) + 1):
                if size > 1:
                    values = (values[:-1] << np.uint64(8)) | part[size - 1 :]
                if size in sizes and len(values):
                    whole = rows[: len(values)] == rows[size - 1 :]
                    row, value = rows[: len(values)][whole], values[whole]
                    some = keep(size, row, value)
                    row, value = row[some], value[some]
                    order = np.lexsort((value, row))
                    row, value = row[order], value[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(row)]
                    yield size, row[new], value[new]
            at = to

    return read


def bit_places(words: int) -> Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from size and values of grams to their word in a bit table and their three bits there."""

    def places(size: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (value + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        one = np.uint64(1)
        bits = (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63))) | (one << ((h >> np.uint64(12)) & np.uint64(63)))
        return ((h >> np.uint64(18)) % np.uint64(words)).astype(np.int64), bits

    return places


def bit_table(grams: DataFrame, how_many: int) -> bytes:
    """A blocked bit table of all grams (``_size, _gram``), sized by their number up to :data:`MAX_WORDS`.

    It is put together in rows of bounded size; at most 64 MB in all reach the driver, whatever the length of the list.
    """
    words, per_row = 64, WORDS_PER_ROW
    while words < MAX_WORDS and words * 64 < how_many * BITS_PER_GRAM:
        words *= 2
    places = bit_places(words)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for size in np.unique(sizes).tolist():
                word, bits = places(size, values[sizes == size])
                yield pa.RecordBatch.from_arrays([pa.array(word // per_row), pa.array(word % per_row), pa.array(bits.view(np.int64))], names=["_row", "_word", "_bits"])

    def fill(key: tuple, marks: pa.Table) -> pa.Table:
        out = np.zeros(min(words, per_row), np.uint64)
        np.bitwise_or.at(out, marks.column("_word").to_numpy(), marks.column("_bits").to_numpy().view(np.uint64))
        return pa.table({"_row": pa.array([key[0].as_py()], pa.int64()), "_set": pa.array([out.tobytes()], pa.binary())})

    marked = grams.select("_size", "_gram").mapInArrow(mark, "_row bigint, _word bigint, _bits bigint").distinct()
    table = np.zeros((words + per_row - 1) // per_row * min(words, per_row), np.uint64)
    for row in marked.groupBy("_row").applyInArrow(fill, "_row bigint, _set binary").collect():
        part = np.frombuffer(row["_set"], np.uint64)
        table[row["_row"] * per_row : row["_row"] * per_row + len(part)] = part
    return table[:words].tobytes()


def _text_grams(texts: DataFrame, keys: Sequence[str], text_col: str, sizes: Sequence[int], bits: bytes, counted: bool) -> DataFrame:
    """Grams of texts that the bit table lets through: each once a text with its keys, or ``counted``: with the number of texts, by batch."""
    held = texts.sparkSession.sparkContext.broadcast(bits)
    read, places, names = _gram_reader(sizes), bit_places(len(bits) // 8), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint64)

        def known(size: int, row: np.ndarray, value: np.ndarray) -> np.ndarray:
            word, bit = places(size, value)
            return (table[word] & bit) == bit

        for batch in batches:
            for size, row, value in read(batch.column(len(names)), known):
                if counted:
                    value, n = np.unique(value, return_counts=True)
                    columns, more = [pa.array(n.astype(np.int64))], ["_texts"]
                else:
                    columns, more = [batch.column(k).take(pa.array(row)) for k in range(len(names))], names
                gram = [pa.array(np.full(len(value), size, np.int32)), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *gram], names=[*more, "_size", "_gram"])

    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    out = "_texts bigint" if counted else ", ".join(f"`{c}` {types[c]}" for c in names)
    return texts.select(*names, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes")).mapInArrow(run, f"{out}, _size int, _gram bigint")


def _by_gram(df: DataFrame, rules: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """(document, rule) pairs where the document contains the gram the rule is filed under.

    Each rule is filed under the one of its grams that the fewest texts hold, so the frequent beginnings that many
    literals share are not used; how many texts hold a gram of the list is counted in a first pass over the texts, exactly.  A second
    pass looks up the grams of each text.  In both, bit tables of the list's grams drop almost all others before any
    row is made of them.  A gram that still meets very many texts is salted, so no task gets more than its share of
    them.  The texts are not moved.
    """
    rules = rules.where(F.length("source") > 0)
    size = F.least(F.octet_length("source"), F.lit(GRAM))
    sources = rules.select("source").distinct().withColumn("_bytes", F.col("source").cast("binary")).withColumn("_size", size)
    read = _gram_reader(range(1, GRAM + 1))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("_size").to_numpy()
            for n, row, value in read(batch.column("_bytes"), lambda size, row, value: wanted[row] == size):  # noqa: B023
                columns = [batch.column("source").take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "_size", "_gram"])

    gram = ["_size", "_gram"]
    filed = shared_checkpoint(sources.mapInArrow(file, "source string, _size int, _gram bigint"))
    listed = filed.groupBy(*gram).agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r["_size"]: r["n"] for r in listed.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # eight rows at most
    every = bit_table(listed, sum(sizes.values()))
    counts = _text_grams(df, [], text_col, list(sizes), every, True).groupBy(*gram).agg(F.sum("_texts").alias("_texts"))
    known = filed.join(listed, gram).join(counts, gram, "left").withColumn("_texts", F.coalesce("_texts", F.lit(0)))
    best = F.min_by(F.struct(*gram, "_texts"), F.struct("_texts", "_n", *gram)).alias("_a")
    anchor = shared_checkpoint(known.groupBy("source").agg(best).select("source", "_a.*"))
    used = anchor.groupBy(*gram).agg(F.max("_texts").alias("_texts"))
    total = used.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_texts"), F.lit(0)).alias("hits")).first()
    hot = F.col("_texts") > max(total["hits"] // HOT_SHARE, HOT_LEAST)  # of at most HOT_SHARE grams
    met = _text_grams(df, keys, text_col, list(sizes), bit_table(used, total["n"]), False)
    marks = used.where(hot).select(*gram, F.lit(True).alias("_hot"))
    salted = met.join(F.broadcast(marks), gram, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*keys), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    copies = F.sequence(F.lit(0), F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0)))
    anchored = rules.join(anchor.withColumn("_salt", F.explode(copies)).drop("_texts"), "source")
    return salted.drop("_hot").join(anchored, [*gram, "_salt"]).drop(*gram, "_salt")
