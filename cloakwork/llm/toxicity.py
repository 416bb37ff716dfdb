"""Toxicity: a factorization machine over hashed terms.

A text is the set of its lower-cased words without outer punctuation, hashed into ``BUCKETS`` terms.
The score is ``sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>)``, so two terms can mean
more together than apart, such as an insult with a group.  Pair vectors are learned for two kinds of terms: those that
survive a sparse linear fit (FTRL with an L1 penalty), and those of pairs whose presence together changes the label by more than
``PAIR_Z`` deviations, whatever either says alone.  For the second, all pairs of the ``PAIR_TERMS`` terms of largest variance
in the training rows are tried.

Training reads at most ``per_class`` labelled rows of each class, those whose hashed ids are smallest,
weighted so that the classes keep their shares; the hashed terms of these rows are all that reaches
the driver.  Scoring is a map over all rows, with whole texts.

Defined cases: a null or empty text has no terms and gets the score of the bias; null labels and ids
are not trained on; repeated labels of an id count once, as the larger; of documents that share an id the one with the smallest terms
is learned from; repeated documents are scored each; without labelled rows every score is 0.  Only the id and text columns are read, so clashing
names of others do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import remainder, ship, table, text_or_empty

BUCKETS = 1 << 18
RANK = 8
PER_CLASS = 10_000
THRESHOLD = 0.7
PAIR_TERMS, PAIR_Z, PAIR_SUPPORT = 1_500, 6.0, 20
_OUTER = b" .,;:!?\"'()[]{}<>*_#$%&|/\\-"


class _Terms(dict):
    """Word to bucket; bounded, as it only saves time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        bucket = zlib.crc32(word.strip(_OUTER)) % BUCKETS
        self[word] = bucket
        return bucket


def terms(text: bytes, known: _Terms) -> np.ndarray:
    """Distinct buckets of a text."""
    words = text.lower().split()
    return np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))


@dataclass(frozen=True)
class Machine:
    """``index`` maps a bucket to a row of ``weights`` and ``pairs``, or to the last row, which is zero."""

    bias: float
    index: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def logits(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``flat``: buckets of all texts, one after the other; ``starts``: where each begins, and the end."""
        at = self.index[flat]
        known = at < len(self.weights) - 1
        starts, at = np.concatenate([[0], np.cumsum(known)])[starts], at[known]
        w, v = self.weights[at], self.pairs[at]
        linear = _sums(w, starts)
        both = 0.5 * (_sums(v, starts) ** 2 - _sums(v * v, starts)).sum(axis=1)
        return self.bias + linear + both


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches between starts; empty stretches give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _batches(rows: list[np.ndarray], y: np.ndarray, c: np.ndarray, rng: np.random.Generator, size: int):
    order = rng.permutation(len(rows))
    for at in range(0, len(order), size):
        pick = order[at : at + size]
        part = [rows[i] for i in pick]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in part])])
        yield np.concatenate([*part, np.zeros(0, np.int32)]).astype(np.int64), starts, y[pick], c[pick]


def _screen(rows: list[np.ndarray], y: np.ndarray, c: np.ndarray, rng: np.random.Generator,
            epochs: int = 20, l1: float = 6.0, alpha: float = 2.0) -> tuple[float, np.ndarray]:
    """Sparse linear fit: bias and weights of all buckets."""
    z, n, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    share = float(np.clip((y * c).sum() / c.sum(), 1e-3, 1 - 1e-3))
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    for _ in range(epochs):
        for flat, starts, yy, cc in _batches(rows, y, c, rng, 128):
            err = (_sigmoid(bias + _sums(w[flat], starts)) - yy) * cc
            each = np.repeat(err, np.diff(starts))
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, each, len(touched))
            grown = n[touched] + g * g
            z[touched] += g - (np.sqrt(grown) - np.sqrt(n[touched])) / alpha * w[touched]
            n[touched] = grown
            zt = z[touched]
            w[touched] = np.where(np.abs(zt) <= l1, 0, -(zt - np.sign(zt) * l1) / ((1 + np.sqrt(grown)) / alpha))
            bias_n += err.sum() ** 2
            bias -= 0.1 * err.sum() / np.sqrt(bias_n)
    return bias, w


def interactions(rows: list[np.ndarray], y: np.ndarray, size: int = PAIR_TERMS, least: float = PAIR_Z) -> list[tuple[int, int, float]]:
    """Pairs of buckets with their deviations, the strongest first: how far labels differ from their mean where both occur or both lack."""
    counts = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), minlength=BUCKETS)
    share = counts / max(1, len(rows))
    often = np.flatnonzero((counts >= PAIR_SUPPORT) & (len(rows) - counts >= PAIR_SUPPORT))
    chosen = often[np.lexsort((often, -(share * (1 - share))[often]))][:size]
    if len(chosen) < 2:
        return []
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    p, off = share[chosen], y - y.mean()
    together = np.zeros((len(chosen), len(chosen)))
    for at in range(0, len(rows), 2_000):
        part = rows[at : at + 2_000]
        x = np.tile(-p.astype(np.float32), (len(part), 1))
        for k, row in enumerate(part):
            have = place[row]
            x[k, have[have >= 0]] += 1
        together += x.T @ (x * off[at : at + len(part), None].astype(np.float32))
    z = np.triu(together / np.sqrt(len(rows) * np.outer(p * (1 - p), p * (1 - p)) * max(y.var(), 1e-12)), 1)
    a, b = np.nonzero(np.abs(z) >= least)
    order = np.argsort(-np.abs(z[a, b]), kind="stable")
    return [(int(chosen[i]), int(chosen[j]), float(z[i, j])) for i, j in zip(a[order], b[order], strict=True)]


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None, rank: int = RANK,
        epochs: int = 30, rate: float = 0.5, l2: float = 1e-3, seed: int = 7) -> Machine:
    """Train on sets of buckets and 0/1 labels."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, float)
    c = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    index = np.zeros(BUCKETS, np.int64)
    if not len(y) or y.min() == y.max():
        bias = -40.0 if not len(y) or y.max() == 0 else 40.0
        return Machine(bias, index, np.zeros(1), np.zeros((1, rank)))
    bias, w = _screen(rows, y, c, rng)
    found = interactions(rows, y)
    active = np.union1d(np.flatnonzero(w), np.array([t for a, b, _ in found for t in (a, b)], np.int64))
    m = len(active)
    index[:] = m
    index[active] = np.arange(m)
    weights_, pairs = np.concatenate([w[active], [0.0]]), np.concatenate([rng.normal(0, 0.05, (m, rank)), np.zeros((1, rank))])
    for k, (a, b, z) in enumerate(found[:rank]):  # the strongest begin on their side
        pairs[index[a], k % rank] += 0.3
        pairs[index[b], k % rank] += 0.3 * np.sign(z)
    kept = [index[r] for r in rows]
    kept = [k[k < m] for k in kept]
    gw, gv, gb = np.full(m + 1, 1e-2), np.full((m + 1, rank), 1e-2), 1.0
    for _ in range(epochs):
        for flat, starts, yy, cc in _batches(kept, y, c, rng, 128):
            v = pairs[flat]
            sums = _sums(v, starts)
            logit = bias + _sums(weights_[flat], starts) + 0.5 * (sums**2 - _sums(v * v, starts)).sum(axis=1)
            err = (_sigmoid(logit) - yy) * cc / len(yy)
            each = np.repeat(err, np.diff(starts))
            touched, inverse = np.unique(flat, return_inverse=True)
            dw = np.bincount(inverse, each, len(touched)) + l2 / len(y) * weights_[touched]
            per = each[:, None] * (np.repeat(sums, np.diff(starts), axis=0) - v)
            dv = np.stack([np.bincount(inverse, per[:, f], len(touched)) for f in range(rank)], axis=1) + l2 / len(y) * pairs[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            weights_[touched] -= rate * dw / np.sqrt(gw[touched])
            pairs[touched] -= rate * dv / np.sqrt(gv[touched])
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
    return Machine(float(bias), index, weights_, pairs)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", per_class: int = PER_CLASS) -> Machine:
    """Fit on at most ``per_class`` documents of each label among those that ``learnable`` allows."""
    ship(docs.sparkSession)
    known = (
        labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.where("label = 1").orderBy(*order).limit(per_class).unionByName(
        known.where("label = 0").orderBy(*order).limit(per_class)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Terms()
        for batch in batches:
            found = [terms(t.as_py(), seen).astype("<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "terms"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id")  # twice ``per_class`` ids at most
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = chosen.select("id", "label", "text").mapInArrow(run, f"id {id_type}, label int, terms binary")
    one = rows.groupBy("id").agg(F.min(F.struct("terms", "label")).alias("r")).select("id", "r.label", "r.terms")
    found = sorted(one.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    y = np.array([r["label"] for r in found], float)
    share = {k: n / max(1, (y == k).sum()) for k, n in counts.items()}
    c = np.array([share[int(v)] for v in y])
    return fit([np.frombuffer(r["terms"], "<i4") for r in found], y, c / c.mean() if len(c) else c)


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` per row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Terms()
        for batch in batches:
            found = [terms(t.as_py(), seen) for t in batch.column("text")]
            starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            logits = machine.logits(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_sigmoid(logits), pa.float64())], names=["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {id_type}, score double")


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Terms()
        for batch in batches:
            found = [terms((t.as_py() or "").encode(), seen) for t in batch.column(at)]
            starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            logits = machine.logits(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64), starts)
            yield batch.filter(pa.array(_sigmoid(logits) < threshold))

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, trained on rows whose crc32 remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    out = scores(docs, machine)
    return out.select(
        F.col("id").alias("doc_id"), (remainder("id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


ORACLE: dict[str, str] = {}
QUERIES = {"op7_toxicity": op7_toxicity}
