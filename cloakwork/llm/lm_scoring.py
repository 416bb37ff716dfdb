"""Language-model scores from a weighted backoff automaton, learned from the corpus itself.

States are the contexts of up to ``ORDER - 1`` words seen in training, and the empty one.  A state has an
arc for every word seen after it, weighted by the smoothed probability, and a failure arc to the state
without its oldest word, weighted by what the context leaves to words not seen after it:

    p(w | h) = (c(hw) + MU * p(w | h')) / (c(h) + MU)        failure weight  MU / (c(h) + MU)
    p(w)     = (c(w) + DELTA) / (N + DELTA * (V + 1))

One traversal per text, left to right, carries the state and adds up arc weights.

No task and no broadcast holds the whole model.  Texts are packed into blocks.  A block sends its distinct
n-grams, as sorted 64-bit hashes with their counts in training rows, to shards by hash range, one row
per block and shard; a shard adds up and answers each block in the same order.  Each block then builds the
part of the automaton that its texts can reach and walks through it.  A frequent n-gram is one number
per block, so no key is hot.

Defined cases: a null or empty text is the end token alone; repeated rows are scored each; without
training rows every token has probability one; an empty table gives an empty result.  Only the id and
text columns are read, so clashing names of others do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import remainder, ship, table, text_or_empty, written

ORDER = 2
MU, DELTA = 300.0, 0.3
BLOCK_BYTES = 1 << 21
SHARD_BYTES = 1 << 24  # text for each shard of n-grams
END = b"\n"  # no word, as words hold no white space

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def blocks(docs: DataFrame, training: Column, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, ids, training, sizes, texts, bytes``: rows packed as they come, texts compressed together."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids: list = []
        marks: list[bool] = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            data = [
                pa.array([(part << 32) + seq], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([marks], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([zip_.compress(b"".join(texts))], pa.binary()), pa.array([held], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(data, names=["block", "ids", "training", "sizes", "texts", "bytes"])

        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for i, mark, text in zip(batch.column("id"), batch.column("mark"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                marks.append(bool(mark.as_py()))
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= block_bytes or len(ids) >= 50_000:
                    yield out()
                    ids, marks, texts, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), training.alias("mark"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"block bigint, ids array<{id_type}>, training array<boolean>, sizes array<bigint>, texts binary, bytes bigint")


class _Block:
    """The tokens of a block and their n-grams."""

    def __init__(self, marks: list[bool], sizes: list[int], packed: bytes, order: int) -> None:
        joined = zstandard.ZstdDecompressor().decompress(packed) if sum(sizes) else b""
        index: dict[bytes, int] = {}
        codes: list[int] = []
        lengths = []
        at = 0
        for size in sizes:
            words = joined[at : at + size].lower().split()
            words.append(END)
            at += size
            lengths.append(len(words))
            codes.extend([index.setdefault(w, len(index)) for w in words])
        self.starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        n = len(codes)
        first = np.zeros(n, np.int64)  # position in its text
        first[:] = np.arange(n) - np.repeat(self.starts[:-1], lengths)
        trained = np.repeat(np.array(marks, bool), lengths)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        gram = hashes[np.array(codes, np.int64)]
        self.keys: list[np.ndarray] = []  # per order, sorted
        self.counts: list[np.ndarray] = []  # per order and key, in the training rows of the block
        self.at: list[np.ndarray] = []  # per order and position, the key, or -1 where the text has too few words before
        words = gram
        for o in range(1, order + 1):
            if o > 1:
                gram = _mix64(np.concatenate([gram[:0], np.zeros(1, np.uint64), gram[:-1]]) * _M2 + words)
            have = np.flatnonzero(first >= o - 1)
            keys, inverse = np.unique(gram[have], return_inverse=True)
            at_ = np.full(n, -1, np.int64)
            at_[have] = inverse
            self.keys.append(keys)
            self.at.append(at_)
            self.counts.append(np.bincount(inverse, trained[have], len(keys)).astype(np.uint64))


def _small(counts: np.ndarray) -> bytes:
    """Counts by byte planes: most are small, so most planes are zero."""
    planes = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys."""
    edges = np.array([(s << 64) // shards for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def shared_counts(packed: DataFrame, shards: int, order: int = ORDER) -> DataFrame:
    """``block, shard, gram, totals, n, v``: totals over all training rows, in the order of a block's keys in that shard.

    ``n`` and ``v`` hold the shard's tokens and distinct words on one of its rows, else 0.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row["training"], row["sizes"], row["texts"], order)
                out: dict[str, list] = {"shard": [], "block": [], "gram": [], "keys": [], "counts": []}
                for o, (keys, counts) in enumerate(zip(block.keys, block.counts, strict=True), 1):
                    edges = _bounds(keys, shards)
                    for s in np.flatnonzero(np.diff(edges)).tolist():
                        a, b = edges[s], edges[s + 1]
                        for c, v in zip(out, (s, row["block"], o, keys[a:b].tobytes(), _small(counts[a:b])), strict=True):
                            out[c].append(v)
                types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for gram, rows in pdf.groupby("gram"):
            keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
            lengths = np.array([len(k) // 8 for k in rows["keys"]])
            counts = np.concatenate([_wide(c) for c in rows["counts"]])
            found, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, counts, len(found))
            answers = np.split(total[inverse].astype(np.uint64), np.cumsum(lengths)[:-1])
            n, v = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            if gram == 1:
                n[0], v[0] = int(total.sum()), int((total > 0).sum())
            parts.append(pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "gram": gram, "totals": [_small(a) for a in answers], "n": n, "v": v}))
        return pd.concat(parts)

    sent = packed.select("block", "training", "sizes", "texts").mapInArrow(send, "shard int, block bigint, gram int, keys binary, counts binary")
    return sent.groupBy("shard").applyInPandas(add, "block bigint, shard int, gram int, totals binary, n bigint, v bigint")


def automaton(block: _Block, totals: list[np.ndarray], n: int, v: int, mu: float = MU, delta: float = DELTA) -> tuple[list[list[float]], list[list[float]]]:
    """Arc and failure weights that the texts of a block meet, per order and position; an arc that is not there is NaN.

    ``arcs[o][i]``: from the state of the ``o - 1`` words before position ``i``; ``fails[o][i]``: of that state.
    """
    arcs: list[list[float]] = [[]]
    fails: list[list[float]] = [[], []]
    count = totals[0][block.at[0]].astype(float)
    p = (count + delta) / (n + delta * (v + 1))
    arcs.append(np.log10(p).tolist())
    for o in range(2, len(totals) + 1):
        at = block.at[o - 1]
        context = np.concatenate([[0.0], count[:-1]])  # of the words before
        count = np.where(at >= 0, totals[o - 1][at] if len(totals[o - 1]) else 0, 0).astype(float)
        p = np.where(at >= 0, (count + mu * p) / (context + mu), p)
        arcs.append(np.where(count > 0, np.log10(p), np.nan).tolist())
        fails.append(np.log10(mu / (context + mu)).tolist())
    return arcs, fails


def traverse(arcs: list[list[float]], fails: list[list[float]], known: list[bool], start: int, end: int) -> float:
    """Walk through the automaton from the empty state; the sum of the weights of all arcs taken."""
    total, state, longest = 0.0, 0, len(arcs) - 2
    for i in range(start, end):
        order = state + 1
        weight = arcs[order][i]
        while weight != weight:  # no such arc: fail to the state without the oldest word
            total += fails[order][i]
            order -= 1
            weight = arcs[order][i]
        total += weight
        state = min(order, longest) if known[i] else 0
    return total


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row; ``training`` marks the rows to learn from."""
    ship(docs.sparkSession)
    packed = written(blocks(docs, training, id_col, text_col), "lm-blocks")
    size = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(16, -(-size // SHARD_BYTES))
    counted = written(shared_counts(packed, shards, order), "lm-counts")
    n, v = (x or 0 for x in counted.agg(F.sum("n"), F.sum("v")).first())
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = texts.iloc[0]
        block = _Block(list(row["training"]), [int(s) for s in row["sizes"]], row["texts"], order)
        answers = answers.sort_values(["gram", "shard"])
        totals = [np.concatenate([np.zeros(0, np.uint64), *map(_wide, answers.loc[answers["gram"] == o, "totals"])]) for o in range(1, order + 1)]
        seen = totals[0][block.at[0]].astype(float)
        base = np.concatenate([[0.0], np.cumsum(np.log10((seen + 1) / (n + v + 1)))])
        known = np.concatenate([[0], np.cumsum(seen > 0)])
        arcs, fails = automaton(block, totals, n, v)
        flags, s = (seen > 0).tolist(), block.starts
        return pd.DataFrame({
            id_col: pd.Series(list(row["ids"]), dtype=object), "held_out": [not m for m in row["training"]],
            "n_tokens": np.diff(s), "n_known": known[s[1:]] - known[s[:-1]], "train_tokens": n,
            "base_score": base[s[1:]] - base[s[:-1]],
            "score": [traverse(arcs, fails, flags, a, b) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)],
        })

    schema = f"`{id_col}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return packed.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(score, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the rows whose crc32 remainder by 7 is not 2."""
    return lm_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


ORACLE: dict[str, str] = {}
QUERIES = {"op2_lm_scoring": op2_lm_scoring}
