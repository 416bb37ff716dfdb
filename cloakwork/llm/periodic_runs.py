"""Periodic runs of words, from maximal pairs.

A run of smallest period q and length L >= 2q is the maximal pair (s, s + q): two equal stretches of L - q
words that start q apart, have different words on their left and different words on their right.  So runs
are exactly the maximal pairs whose distance is at most the length of their stretches; where the same run
also shows at multiples of its period, the smallest distance is the period.  Nothing is extended.

1. Words become numbers.  A pair needs stretches of at least half the least run length, so only documents take
   part in which so many words occur twice in a row.
2. Their suffixes are sorted by prefix doubling; the ranks of all levels give the longest common prefix (LCP)
   of neighbours.
3. The LCP-interval tree is visited bottom-up.  Each interval keeps the positions below it in lists by their
   left word.  When a child joins, each position of the smaller side looks for positions of other left words
   within the interval's depth: those are maximal pairs, since different children differ on the right.

Steps 1 and 2 work on a batch of documents at once.  Everything stays inside the row's task: no shuffle.

Defined cases: a null, empty or blank text has no words and no runs; repeated rows each get their row; an
empty table gives an empty result; very long texts are processed whole.  Other columns, also ones that
clash with the names added here, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import ship, table, text_or_empty

LEAST = 12  # words of a run
GROUP_WORDS = 400_000  # words that are sorted together; a longer document is sorted alone
RUN = "start bigint, length bigint, period bigint"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_P = np.uint64(0x9E3779B97F4A7C15)


def _repeated(numbers: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Places whose next ``width`` words may occur again in the same document (no such place is missing)."""
    n = len(numbers) - width + 1
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * _P
    h = doc[:n].astype(np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _P + mixed[k : k + n]
    h ^= h >> np.uint64(32)
    slots = np.uint64((1 << max(10, (4 * n).bit_length())) - 1)
    low = (h & slots).astype(np.int64)
    places = np.flatnonzero(np.bincount(low, minlength=int(slots) + 1)[low] > 1)
    _, which, times = np.unique(h[places], return_inverse=True, return_counts=True)
    return places[times[which] > 1]


def _classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by these keys, first key first, and for each place in it whether a class of equal keys begins there."""
    order = np.lexsort(keys[::-1])
    begins = np.zeros(len(order), bool)
    begins[:1] = True
    for key in keys:
        key = key[order]
        begins[1:] |= key[1:] != key[:-1]
    return order, begins


def _prefixes(numbers: np.ndarray, places: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorting keys of the next ``width`` words, several words a key."""
    low = int(numbers.min())
    bits = (int(numbers.max()) - low + 1).bit_length()
    keys, room = [], 0
    for k in range(width):
        word = numbers[places + k] - low
        if room < bits:
            keys.append(word)
            room = 62 - bits
        else:
            keys[-1] = (keys[-1] << bits) + word
            room -= bits
    return keys


def _suffixes(numbers: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by document and word numbers, and the LCP of each with the one before it; below ``width`` it is given as 0.

    Only documents in which ``width`` words occur again are looked at.  Each document ends with a number of its own,
    so a prefix that two suffixes share never reaches beyond the end.
    """
    has = np.zeros(int(doc.max()) + 1, bool)
    has[doc[_repeated(numbers, doc, width)]] = True
    places = np.flatnonzero(has[doc])
    order, begins = _classes([doc[places], *_prefixes(numbers, places, width)])
    suffixes = places[order]
    rank = np.zeros(len(numbers), np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    levels, step = [rank], width
    active = np.flatnonzero(~(begins & np.append(begins[1:], True)))
    while len(active):
        held = suffixes[active]
        order, begins = _classes([rank[held], rank[held + step]])
        suffixes[active] = held[order]
        rank = rank.copy()
        rank[suffixes[active]] = active[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        levels.append(rank)
        step *= 2
        active = active[~(begins & np.append(begins[1:], True))]
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        common += np.where(levels[k][left + common] == levels[k][right + common], width << k, 0)
    for _ in range(width - 1):
        common += (common >= width) & (numbers[left + common] == numbers[right + common])
    return suffixes, np.append(0, common) if len(suffixes) else common


class _Interval:
    """An LCP interval: its depth, all positions below it, and the same positions by their left word."""

    __slots__ = ("depth", "all", "by_left")

    def __init__(self, depth: int, position: int | None = None, left: int = -1) -> None:
        self.depth = depth
        self.all = [] if position is None else [position]
        self.by_left = {} if position is None else {left: [position]}


def _join(node: _Interval, child: _Interval, left: list[int], found: dict[tuple[int, int], int], least: int) -> None:
    """Report the maximal pairs between both, no further apart than ``node.depth``; then put the child's positions into the node."""
    depth = node.depth
    if len(child.all) > len(node.all):
        node.all, child.all, node.by_left, child.by_left = child.all, node.all, child.by_left, node.by_left
    everything, by_left = node.all, node.by_left
    for i in child.all:
        low, high = bisect_left(everything, i - depth), bisect_right(everything, i + depth)
        if low == high:
            continue
        own, near = left[i], []
        if high - low <= 2 * len(by_left):
            near = [j for j in everything[low:high] if left[j] != own]
        else:
            for word, places in by_left.items():
                if word != own:
                    near += places[bisect_left(places, i - depth) : bisect_right(places, i + depth)]
        for j in near:
            start, period = (i, j - i) if i < j else (j, i - j)
            length = depth + period
            if length >= least and found.get((start, length), period) >= period:
                found[start, length] = period
    for i in child.all:
        insort(everything, i)
    for word, places in child.by_left.items():
        mine = by_left.get(word)
        if mine is None:
            by_left[word] = places
        else:
            for i in places:
                insort(mine, i)


def _maximal_pairs(suffixes: np.ndarray, common: np.ndarray, numbers: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """``(start, length): period`` of every run, by a bottom-up visit of the LCP-interval tree."""
    found: dict[tuple[int, int], int] = {}
    if not len(suffixes):
        return found
    roots = np.flatnonzero(common == 0)
    # A class of suffixes holds no pair where its closest two positions are further apart than its deepest interval.
    klass = np.cumsum(common == 0) - 1
    by_place = np.lexsort((suffixes, klass))
    gap = np.diff(suffixes[by_place], prepend=0)
    gap[roots] = np.iinfo(np.int64).max
    useful = np.minimum.reduceat(gap, roots) <= np.maximum.reduceat(common, roots)
    left = np.append(-1, numbers[:-1])
    ends = np.append(roots[1:], len(suffixes))
    for at, end in zip(roots[useful].tolist(), ends[useful].tolist(), strict=True):
        places, depths = suffixes[at:end].tolist(), common[at:end].tolist()
        lefts = dict(zip(places, left[suffixes[at:end]].tolist(), strict=True))
        stack: list[_Interval] = []
        carried = _Interval(0, places[0], lefts[places[0]])
        for place, depth in zip(places[1:] + [-1], depths[1:] + [0], strict=True):
            # ``carried`` hangs below the deeper of its two neighbours in the order.
            while stack and stack[-1].depth > depth:
                _join(stack[-1], carried, lefts, found, least)
                carried = stack.pop()
            if depth:
                if not stack or stack[-1].depth < depth:
                    stack.append(_Interval(depth))
                _join(stack[-1], carried, lefts, found, least)
                carried = _Interval(0, place, lefts[place])
    return found


def _runs(numbers: np.ndarray, doc: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """``(start, length): period`` of the runs of all documents, places counted over all of them."""
    return _maximal_pairs(*_suffixes(numbers, doc, (least + 1) // 2), numbers, least)


def _documents(texts: list[bytes], least: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs, by start and then period, of each text."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    number = defaultdict(count(len(texts)).__next__)  # smaller numbers are the ends of documents
    flat = np.empty(int(sizes.sum()) + len(texts) + least, np.int64)  # with room for stretches that begin near the end
    doc = np.repeat(np.append(np.arange(len(texts)), len(texts)), np.append(sizes + 1, least))
    flat[-least:] = np.arange(least) - least
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    for k, w in enumerate(words):
        flat[begin[k] : begin[k] + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        flat[begin[k + 1] - 1] = k
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, length), period in _runs(flat, doc, least).items():
        k = int(doc[start])
        runs[k].append((start - int(begin[k]), length, period))
    for w, r in zip(words, runs, strict=True):
        yield w, sorted(r, key=lambda x: (x[0], x[2]))


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id, runs, collapsed`` per row: its runs by start and then period, and its text without the repetitions.

    ``runs`` holds ``start`` and ``length`` in words and the smallest ``period``; ``collapsed`` is the words that
    stay, joined by one space.  Words are what ASCII white space separates.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t.as_py() for t in batch.column(1)]
            at = 0
            while at < len(texts):
                end, held = at + 1, len(texts[at])
                while end < len(texts) and held + len(texts[end]) <= 6 * GROUP_WORDS:
                    held += len(texts[end])
                    end += 1
                runs, collapsed = [], []
                for words, found in _documents(texts[at:end], least):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    collapsed.append(b" ".join(_kept(words, found)))
                columns = [ids.slice(at, end - at), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "runs", "collapsed"])
                at = end

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, runs array<struct<{RUN.replace(' bigint', ':bigint')}>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col``, where documents whose crc32 of the id ends in 0 repeat a stretch of words up to their end."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    chosen = h % 10 == 0
    words = F.filter(F.split(text_or_empty(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text_"), F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, cast(g % n AS int), null)"))
    rows = rows.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) AS int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a)")
    again = F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")
    return rows.select(id_col, F.when(F.col("a").isNotNull(), again).otherwise(F.col("text_")).alias(text_col))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs: their number, the longest, and digests of all of them and of the text without repetitions."""
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))

    def hashed(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    rows = found.select("id", F.size("runs").cast("bigint").alias("n_runs"), F.get(longest, F.lit(0)).alias("top"),
                        hashed(F.array_join(lines, "")).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = -F.col("top.order"), F.col("top.period")
    return rows.select(
        F.col("id").alias("doc_id"), "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


ORACLE: dict[str, str] = {}  # suffix order and interval trees have no SQL; see tests/llm
QUERIES = {"op11_periodic_runs": op11_periodic_runs}
