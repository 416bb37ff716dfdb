"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Tasks tokenise whole documents and cut them into pieces of at most the sequence length.
2. Piece lengths are counted into a histogram of ``length / GRID`` classes (512 at most); only that
   histogram reaches the driver.
3. A linear program over patterns (how many pieces of each class share a sequence) is solved by
   column generation: the simplex method holds the patterns in use, an unbounded knapsack by dynamic
   programming prices new ones, and it stops when no pattern can gain more than a small tolerance.
4. Pattern counts are rounded down; the few pieces left over are packed first-fit decreasing.
5. Pieces are ranked inside their class and take the pattern slots in that order.  Ranks come
   from hash buckets and per-bucket counts, so a class with very many pieces is not sorted in one task.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed each
by itself; an empty table gives an empty result.  Only the id and text columns are read, so clashing
names of others do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import cut, ship, table, text_or_empty
from cloakwork.llm.tokens import encoder

SEQUENCE = 2048
GRID = 4
BUCKETS = 1024
TOLERANCE = 1e-3  # of the number of sequences
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           sequence: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece of at most ``sequence`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                rows += [(doc, s, min(sequence, n - s), zlib.crc32(ids[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint"), text_or_empty(text_col)).mapInArrow(run, PIECES)


def _best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: class ``k`` (1-based) fills ``k`` of ``capacity`` units and is worth ``prices[k - 1]``."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = prices[:c] + best[c - 1 :: -1][:c]
        k = int(worth.argmax())
        best[c], took[c] = (worth[k], k + 1) if worth[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _greedy(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """First fit decreasing by patterns: each fills up with the largest classes left and is used as often as the rest allows."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        room, pattern = len(left), np.zeros(len(left), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            if (take := min(room // (k + 1), left[k])) > 0:
                pattern[k] = take
                room -= take * (k + 1)
        hold = pattern > 0
        times = int((left[hold] // pattern[hold]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def solve_patterns(demand: np.ndarray, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, float]]:
    """Patterns over the classes with demand, and how often the linear program uses each.

    Minimises the number of sequences subject to meeting ``demand`` exactly.  ``demand[k - 1]`` pieces
    fill ``k`` units of ``len(demand)``.  Starts from one pattern per class, repeated as it fits, takes in
    the greedy patterns that gain, and then the ones that the knapsack finds.
    """
    capacity = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    fit = capacity // (used + 1)
    basis = np.diag(fit).astype(float)
    inverse, x = np.diag(1 / fit), demand[used] / fit

    def enter(column: np.ndarray) -> bool:
        """Take a pattern into the basis; another leaves."""
        nonlocal x
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        basis[:, out] = column
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        row = inverse[out] / d[out]
        inverse[:] -= np.outer(d, row)
        inverse[out] = row
        return True

    for pattern, _ in _greedy(demand):
        column = pattern[used].astype(float)
        if inverse.sum(axis=0) @ column > 1 + 1e-9:
            enter(column)
    for _ in range(50 * len(used) + 100):
        prices = np.zeros(capacity)
        prices[used] = inverse.sum(axis=0)
        value, pattern = _best_pattern(prices, capacity)
        # No solution uses fewer than x.sum() / value sequences.
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= max(tolerance * x.sum(), 0.5):
            break
        if not enter(pattern[used].astype(float)):
            break
    patterns = []
    for j in range(len(used)):
        if x[j] > 0:
            full = np.zeros(capacity, np.int64)
            full[used] = np.rint(basis[:, j]).astype(np.int64)
            patterns.append((full, float(x[j])))
    return patterns


def plan_sequences(demand: np.ndarray, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole counts that place every piece once: the rounded program, then first fit decreasing."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, times in sorted(solve_patterns(demand, tolerance), key=lambda p: -p[1]):
        hold = pattern > 0
        whole = int(min(np.floor(times + 1e-6), (left[hold] // pattern[hold]).min()))
        if whole > 0:
            plan.append((pattern, whole))
            left -= whole * pattern
    return plan + _greedy(left)


def _slots(plan: Iterable[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: first rank, pieces in the pattern, and first sequence of each pattern that holds it."""
    by_class: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        for k in np.flatnonzero(pattern).tolist():
            by_class.setdefault(k + 1, []).append((taken.get(k + 1, 0), int(pattern[k]), sequence))
            taken[k + 1] = taken.get(k + 1, 0) + int(pattern[k]) * times
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for k, rows in by_class.items()}


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE, grid: int = GRID, buckets: int = BUCKETS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """Pieces (columns of :data:`PIECES`, read several times) with ``sequence_id`` and ``offset``."""
    if sequence % grid:
        raise ValueError("grid must divide the sequence length")
    classed = cut_pieces.withColumn("klass", F.ceil(F.col("length") / grid).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")
    )
    counts = classed.groupBy("klass", "bucket").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(sequence // grid, np.int64)
    for klass, n in counts.groupBy("klass").agg(F.sum("n")).collect():  # one row per class
        demand[klass - 1] = n
    slots = _slots(plan_sequences(demand, tolerance))

    in_class = Window.partitionBy("klass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("klass", "bucket", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("klass", "bucket").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = (
        classed.withColumn("rank", F.row_number().over(in_bucket) - 1)
        .join(starts, ["klass", "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("before", "bucket")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            klass, rank = batch.column("klass").to_numpy(), batch.column("rank").to_numpy()
            seq = np.empty(len(rank), np.int64)
            slot = np.empty(len(rank), np.int64)
            for k in np.unique(klass).tolist():
                here = np.flatnonzero(klass == k)
                first, per, base = slots[k]
                at = np.searchsorted(first, rank[here], "right") - 1
                inside = rank[here] - first[at]
                seq[here], slot[here] = base[at] + inside // per[at], inside % per[at]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "klass"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(seq), pa.array(slot)],
                                             names=[*names, "sequence_id", "slot"])

    spots = ranked.mapInArrow(place, f"{PIECES}, klass int, sequence_id bigint, slot bigint")
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("klass"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("bigint")
    return spots.withColumn("offset", offset).drop("klass", "slot")


def default_tokenizer() -> str:
    """Path of the public byte-level tokenizer; callers may pass any other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   sequence: int = SEQUENCE) -> DataFrame:
    """Tokenise, cut and pack all documents: the columns of :data:`PIECES`, ``sequence_id`` and ``offset``."""
    return pack(cut(pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, sequence)), sequence)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_packing": op1_packing}
