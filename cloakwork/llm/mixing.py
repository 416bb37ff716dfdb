"""Mixing sources to target weights by temperature.

1. Tokens (words) are summed per source; shares are raised to an exponent and normalised to weights.
2. The exponent is bisected between 0 (equal weights) and 1 (shares as they are) to the smallest value at
   which the weights' entropy is at most the target and no source is repeated more often than the limit.
3. The token budget is what the source with the lowest weight-to-share ratio needs to be read ``least_epochs``
   times; by default 1, so that every document stays.
4. A source's budget is realised epoch by epoch: whole permutations, and of the last one a prefix.  Documents
   are hashed into blocks; an epoch orders the blocks by hash, takes whole ones while they fit, and
   cuts the block at the border document by document.  Block sums are small and blocks number with the
   data, so no task sorts a whole source.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and belongs to
every whole epoch, not to a partial one; repeated rows are drawn each; an empty table, or one without any
tokens, gives each document once.  Other columns pass through; names used inside avoid theirs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import WORD, cut, fresh, table, text_or_empty

MAX_SOURCES = 100_000  # more raise: the table of sources is the one thing that reaches the driver
REPEATS = 2.0
BLOCK_ROWS = 1_000


class Share(NamedTuple):
    source: str | None
    tokens: int
    rows: int


class Budget(NamedTuple):
    source: str | None
    weight: float
    tokens: int  # to draw
    whole: int  # epochs in full
    part: int  # tokens of the last, partial epoch


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised powers of the shares; sources without tokens get none."""
    total = sum(tokens)
    powers = [math.exp(exponent * math.log(t / total)) if t else 0.0 for t in tokens]
    norm = math.fsum(powers)
    return [p / norm for p in powers]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log2(x) for x in w if x > 0)


def repetition(tokens: list[int], w: list[float], least_epochs: float) -> list[float]:
    """Epochs of each source when the one read least is read ``least_epochs`` times."""
    ratio = [x / t if t else 0.0 for x, t in zip(w, tokens, strict=True)]
    low = min((r for r in ratio if r > 0), default=1.0)
    return [least_epochs * r / low for r in ratio]


def exponent_for(tokens: list[int], target_entropy: float | None, repeats: float, least_epochs: float, steps: int = 60) -> float:
    """Smallest exponent in [0, 1] that keeps to the entropy target and the repetition limit; 1 if none smaller does."""

    def fits(exponent: float) -> bool:
        w = weights(tokens, exponent)
        if target_entropy is not None and entropy(w) > target_entropy + 1e-12:
            return False
        return max(repetition(tokens, w, least_epochs), default=0.0) <= repeats + 1e-9

    if not any(tokens) or fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def budgets(shares: list[Share], target_entropy: float | None = None, repeats: float = REPEATS, least_epochs: float = 1.0) -> list[Budget]:
    """What to draw from each source."""
    tokens = [s.tokens for s in shares]
    if not any(tokens):
        return [Budget(s.source, 0.0, 0, 1, 0) for s in shares]
    w = weights(tokens, exponent_for(tokens, target_entropy, repeats, least_epochs))
    out = []
    for s, x, epochs in zip(shares, w, repetition(tokens, w, least_epochs), strict=True):
        draw = round(epochs * s.tokens)
        whole, part = divmod(draw, s.tokens) if s.tokens else (1, 0)
        out.append(Budget(s.source, x, draw, whole, part))
    return out


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _source_table(spark: SparkSession, plan: list[Budget], kind: str) -> DataFrame:
    schema = f"src {kind}, weight double, budget bigint, whole bigint, part bigint"
    return spark.createDataFrame([tuple(b) for b in plan], schema)


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        target_entropy: float | None = None, repeats: float = REPEATS, least_epochs: float = 1.0,
        seed: int = 17, block_rows: int = BLOCK_ROWS, with_report: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as its source's budget draws it.

    With ``with_report`` the result is instead ``id, source, tokens, epoch, block, weight`` of every draw.
    """
    spark = docs.sparkSession
    small = docs.select(F.col(source_col).alias("s"), F.col(id_col).alias("i"), token_count(text_or_empty(text_col)).alias("t"))
    # Rows that are equal in these three are told apart by their number of occurrences.
    drawn = cut(small.groupBy("s", "i", "t").agg(F.count(F.lit(1)).alias("copies")))
    grouped = drawn.groupBy("s").agg(F.sum(F.col("t") * F.col("copies")).alias("t"), F.sum("copies").alias("n"))
    head = grouped.orderBy("s").limit(MAX_SOURCES + 1).collect()
    if len(head) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = budgets([Share(r["s"], r["t"], r["n"]) for r in head], target_entropy, repeats, least_epochs)
    kind = docs.schema[source_col].dataType.simpleString()
    sources = _source_table(spark, plan, kind)

    blocks = max(1, sum(r["n"] for r in head) // block_rows)
    placed = drawn.withColumn("block", F.pmod(F.xxhash64("i", "t", F.lit(seed)), F.lit(blocks)))
    order = F.xxhash64(F.lit(seed + 1), F.col("s"), F.col("block"))
    sums = placed.groupBy("s", "block").agg(F.sum(F.col("t") * F.col("copies")).alias("bt")).withColumn("o", order)
    before = Window.partitionBy("s").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bt").over(before), F.lit(0))).drop("o")
    # ``sources`` has MAX_SOURCES rows at most.
    left = sums.join(F.broadcast(sources), F.col("s").eqNullSafe(F.col("src"))).select(
        "s", "block", "bt", "weight", "whole", (F.col("part") - F.col("before")).alias("room")
    ).alias("l")
    rows = placed.alias("p").join(left, F.col("p.s").eqNullSafe(F.col("l.s")) & (F.col("p.block") == F.col("l.block"))).select(
        "p.s", "p.i", "p.t", "p.copies", "p.block", "weight", "whole", "room", "bt"
    )
    inside = Window.partitionBy("s", "block").orderBy(F.xxhash64(F.lit(seed + 2), F.col("i"), F.col("t")), "i", "t")
    upto = F.sum(F.col("t") * F.col("copies")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto)
    # Of equal rows at the border, as many as still fit.
    fit = F.when(F.col("t") == 0, 0).when(F.col("room") >= F.col("upto"), F.col("copies")).otherwise(
        F.greatest(F.lit(0), F.floor((F.col("room") - F.col("upto") + F.col("t") * F.col("copies")) / F.col("t")))
    )
    rows = rows.withColumn("extra", F.least(fit.cast("bigint"), F.col("copies")))
    if with_report:
        one = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        draws = F.col("whole") + (F.col("copy") <= F.col("extra")).cast("bigint")
        epochs = one.withColumn("draws", draws).where("draws > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("draws"))))
        return epochs.select(F.col("i").alias("id"), F.col("s").alias("source"), F.col("t").alias("tokens"), "epoch", "block", "weight")

    ti, whole, extra, copies, nth, draws = fresh(docs, "_tokens", "_whole", "_extra", "_copies", "_nth", "_draws")
    counts = rows.select(F.col("s").alias("_s"), F.col("i").alias("_i"), F.col("t").alias("_t"), F.col("whole").alias(whole), F.col("extra").alias(extra), F.col("copies").alias(copies)).alias("c")
    full = docs.withColumn(ti, token_count(text_or_empty(text_col)))
    same = (
        full[source_col].eqNullSafe(F.col("c._s")) & full[id_col].eqNullSafe(F.col("c._i")) & (full[ti] == F.col("c._t"))
    )
    joined = full.join(counts, same).select(*[full[c] for c in full.columns], whole, extra, copies)
    # Rows equal in id, source and tokens share the extra draws by turns.
    turn = F.row_number().over(Window.partitionBy(source_col, id_col, ti).orderBy(F.lit(0)))
    repeated = joined.where(F.col(copies) > 1).withColumn(nth, turn)
    single = joined.where(F.col(copies) == 1).withColumn(nth, F.lit(1))
    every = single.unionByName(repeated).withColumn(draws, F.col(whole) + (F.col(nth) <= F.col(extra)).cast("bigint"))
    return every.where(F.col(draws) > 0).withColumn(draws, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(draws)))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw from all documents: small sources are read up to twice, none is cut."""
    mixed = mix(table(spark, sf_dir, "documents"), with_report=True)
    return mixed.withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op3_mixing": op3_mixing}
