"""Near duplicates: circulant MinHash, banding, and exact Jaccard on full shingle sets.

A document's set holds its distinct five-word shingles, as 64-bit hashes.  One permutation scatters the
set over a ring of 2**32 places; coordinate k of the signature is the smallest value of a second
permutation after shifting the ring by k.  So two permutations make all ``COORDINATES``.  They are banded by
``ROWS``; a pair at the threshold shares no band with probability 5e-6.

Equal sets are one class from the start.  Buckets are worked through without writing down pairs of their members:

1. every member of a bucket is compared with the bucket's smallest one; links join components;
2. buckets that still hold several components are put together where they overlap, and each such cluster goes to one task, small
   ones several at a time, large ones as every two of their blocks of at most ``BLOCK`` bytes of sets;
3. such a task finds all its links exactly.  Shingles are put in order, from the rarest to the most frequent in the
   task.  A set files its first ``n - ceil(6n/7) + 1`` shingles, and every set at least as large looks up its first
   ``n - ceil(3n/4) + 1``: a pair at the threshold meets there, early enough for the rest to suffice.  Texts that share only a core below 6/7 of
   their sets do not meet, since the core comes last.  Those that meet between components are compared on full sets; only links
   leave the task.

All buckets take this one way, whatever their size.  The work of a cluster grows with the square of its blocks.
Every link is confirmed on the full sets.  Components come from forests of bounded parts of the links, and
from alternating large and small stars between them.

Texts are not moved: a task that reads them makes the sets that are wanted, which a bit table of at most 64 MB tells it.

Defined cases: a document without words (or null) has an empty set and is linked with nothing; one with
fewer than five words has one shingle; rows that share an id are told apart by their texts; a null id is
never the smallest of a component unless it has no other; an empty table gives an empty result.
Only the id and text columns are read, so clashing names of others do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.llm.common import cut, fresh, ship, table, text_or_empty, written
from cloakwork.operators.literals import bit_places, bit_table

SHINGLE = 5
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
THRESHOLD = 75  # percent
GUESS = 0.55  # least share of equal coordinates for the first step, which only saves work for the others
BLOCK = 1 << 24  # bytes of sets
MEETINGS = 1 << 20  # pairs looked at together
EDGES = 200_000  # edges that a task reduces to a forest

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """Word to 64-bit hash; bounded, as it only saves time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, known: _Words, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; ``text`` is UTF-8."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    h = np.full(len(words) - span + 1, span, np.uint64)
    for j in range(span):
        h = _mix64(h + each[j : len(each) - span + 1 + j])
    return np.unique(h)


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash of a non-empty set."""
    place = (_mix64(found) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 4096):
        x = place[None, at : at + 4096] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        least = np.minimum(least, x.min(axis=1))
    return least


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = coordinates.astype(np.uint64).reshape(-1, rows)
    h = np.arange(len(bands), dtype=np.uint64)
    for j in range(rows):
        h = _mix64(h * _M2 + bands[:, j])
    return h.view(np.int64)


def _fingerprint(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n, print, bands, sig`` per row: set size, fingerprint of the set, band keys, low bytes of the signature."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, prints, bands, sigs = [], [], [], []
                for text in part.column("text"):
                    found = shingles(text.as_py(), known)
                    sig = signature(found) if len(found) else np.zeros(0, np.uint32)
                    n.append(len(found))
                    prints.append(_fingerprint(found))
                    bands.append(band_keys(sig).tolist() if len(found) else [])
                    sigs.append(sig.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(sigs, pa.binary())],
                    names=["id", "text_hash", "n", "print", "bands", "sig"])

    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return texts.mapInArrow(run, f"id {id_type}, text_hash bigint, n bigint, print binary, bands array<bigint>, sig binary")


def item_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full sets of the classes in ``wanted`` (``node, id, text_hash, print``), from the texts: ``node, items``.

    A bit table of ids and texts drops almost all other rows before their sets are made; the print decides.
    """
    marks = wanted.select(F.lit(0).alias("_size"), F.xxhash64("id", "text_hash").alias("_gram"))
    bits = bit_table(marks, wanted.count())
    held, places = docs.sparkSession.sparkContext.broadcast(bits), bit_places(len(bits) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done, table_ = _Words(), set(), np.frombuffer(held.value, np.uint64)
        for batch in batches:
            word, bit = places(0, batch.column("mark").to_numpy().view(np.uint64))
            prints, items = [], []
            for k in np.flatnonzero((table_[word] & bit) == bit).tolist():
                found = shingles(batch.column("text")[k].as_py(), known)
                mark = _fingerprint(found)
                if mark not in done:  # repeated rows of a class; at most as many marks as wanted sets, and a few chance ones
                    done.add(mark)
                    prints.append(mark)
                    items.append(found.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(items, pa.binary())], names=["p", "items"])

    text = text_or_empty(text_col)
    texts = docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text)).alias("mark"), text.cast("binary").alias("text"))
    made = texts.mapInArrow(run, "p binary, items binary")
    return made.join(wanted.select("node", "print"), F.col("p") == F.col("print")).select("node", "items").dropDuplicates(["node"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u, v`` of one task to ``node, smallest node reachable by them``: as connected, with fewer rows."""
    pairs = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not pairs:
        return
    name, ends = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    root = list(range(len(name)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for x, y in ends.reshape(2, -1).T.tolist():
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    low = np.array([top(k) for k in range(len(name))])
    inner = low != np.arange(len(name))
    yield pa.RecordBatch.from_arrays([pa.array(name[inner]), pa.array(name[low[inner]])], names=["u", "v"])


def components(edges: DataFrame, task: int = EDGES) -> DataFrame:
    """``a, b`` to ``node, component`` (the smallest node reachable), for all nodes but the smallest of each.

    Each task first reduces its edges to a forest.  What does not fit a task of ``task`` edges goes through rounds of
    large and small stars until nothing changes or the rest fits.
    """

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    def reduced(frame: DataFrame, rows: int) -> DataFrame:
        dealt = frame.coalesce(1) if rows <= task else frame.repartition(-(-rows // task))
        return cut(dealt.mapInArrow(_forest, "u bigint, v bigint"))

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    rows = e.count()
    e = reduced(e, rows)
    seen = None
    while rows > task:
        now = mark(e)
        if now == seen:
            break
        if now[0] <= task:
            e = reduced(e, now[0])
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose signatures agree on enough coordinates."""
    s = sigs.select("node", "sig")
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((sa == sb).mean(axis=1) >= GUESS))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= threshold * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``a, b`` whose full sets reach the threshold.  ``sets``: ``node, items``."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia"), batch.column("ib"), strict=True):
                keep.append(_linked(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ia", "ib").mapInArrow(run, "a bigint, b bigint")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    stats = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(stats.where("low < high").select("key"), "key")


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of each bucket's smallest member with the others; ``rows``: ``key, node``."""
    least = rows.groupBy("key").agg(F.min("node").alias("a"))
    return rows.join(least, "key").where("node > a").select("a", F.col("node").alias("b")).distinct()


def meetings(sets: list[np.ndarray], component: np.ndarray, threshold: int = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of sets of different components that may reach the threshold, repeated ones among them; none that does is missing."""
    n = np.array([len(x) for x in sets], np.int64)
    value, shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((shingle, times[shingle], owner))
    shingle, owner = shingle[order], owner[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    # Shingles whose holders are all of one component bring nothing new, which covers those that one set has alone.
    low, high = np.full(len(value), np.iinfo(np.int64).max), np.full(len(value), -1)
    np.minimum.at(low, shingle, component[owner])
    np.maximum.at(high, shingle, component[owner])
    useful = (low < high)[shingle]
    files = np.flatnonzero(useful & (place <= n[owner] + (-2 * threshold * n[owner]) // (100 + threshold)))
    looks = np.flatnonzero(useful & (place <= n[owner] + (-threshold * n[owner]) // 100))
    files = files[np.argsort(shingle[files], kind="stable")]
    first, last = (np.searchsorted(shingle[files], shingle[looks], side) for side in ("left", "right"))
    many = last - first
    bounds = np.append(0, np.cumsum(many))
    at = 0
    while at < len(looks):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + MEETINGS, "right")) - 1)
        y = np.repeat(looks[at:to], many[at:to])
        x = files[np.arange(len(y)) - np.repeat(bounds[at:to] - bounds[at] - first[at:to], many[at:to])]
        a, b = owner[x], owner[y]
        na, nb = n[a], n[b]
        fits = (component[a] != component[b]) & ((na < nb) | (na == nb) & (a < b)) & (100 * na >= threshold * nb)
        # If this is their first common shingle, all their common ones are from here on in either.
        fits &= (100 + threshold) * np.minimum(na - place[x], nb - place[y]) >= threshold * (na + nb)
        yield a[fits], b[fits]
        at = to


def _links_inside(threshold: int = THRESHOLD) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        node, component, part = (rows.column(c).to_numpy() for c in ("node", "component", "part"))
        sets = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("items")]
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        failed: set[int] = set()
        for a, b in meetings(sets, component, threshold):
            across = (part[a] != part[b]) | (p == q)
            for k in np.unique(a[across] * len(sets) + b[across]).tolist():
                x, y = divmod(k, len(sets))
                cx, cy = top(int(component[x])), top(int(component[y]))
                if cx == cy or k in failed:
                    continue
                if _linked(sets[x], sets[y], threshold):
                    root[max(cx, cy)] = min(cx, cy)
                    out.append((min(node[x], node[y]), max(node[x], node[y])))
                elif len(failed) < MEETINGS:
                    failed.add(k)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def links_between(rows: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """Links between components of the same bucket, enough to join them; ``rows``: ``key, node, component`` of mixed buckets.

    ``sets`` gives the full sets of a frame of nodes.
    """
    low = rows.groupBy("key").agg(F.min("node").alias("b"))
    star = rows.join(low, "key").where("node > b").select(F.col("node").alias("a"), "b")
    clusters = components(star).withColumnRenamed("component", "cluster")
    members = rows.select("node", "component").distinct().join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    members = cut(members.join(nodes.select("node", "n"), "node"))
    volume = members.groupBy("cluster").agg((8 * F.sum("n")).alias("bytes")).withColumn("blocks", F.ceil(F.col("bytes") / block))
    little = volume.where("blocks = 1").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    tasks = 1 + 4 * little // block  # small clusters share tasks of a quarter of a block
    alone = F.col("blocks") > 1
    placed = members.join(volume.select("cluster", "blocks"), "cluster")
    placed = placed.withColumn("part", F.when(alone, F.pmod(F.xxhash64("node"), "blocks")).otherwise(0).cast("bigint"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    share = F.when(alone, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(tasks)))
    dealt = placed.select("node", "component", "part", share.alias("share"), F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    full = sets(members.select("node"))
    return dealt.join(full, "node").groupBy("share", "p", "q").applyInArrow(_links_inside(), "a bigint, b bigint").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows (``id, n, print``), and classes of equal sets with their component:
    ``print, id, component_id, first`` (``first`` marks the class that has the component's smallest id).
    """
    ship(docs.sparkSession)
    rows = written(profiles(docs, id_col, text_col), "near-profiles")
    full = rows.where("n > 0")

    def sets(ends: DataFrame) -> DataFrame:
        return written(item_sets(docs, classes.join(ends, "node"), id_col, text_col), "near-sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return cut(confirmed(pairs, sets(ends)))

    # The class's row: the smallest id, a null one only where there is no other.
    row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("row")
    classes = cut(full.groupBy("print").agg(row).select("print", "row.id", "row.text_hash", F.monotonically_increasing_id().alias("node")))
    # One row per class, found by print, id and text together, so that many copies of a text are spread.
    named = classes.select(F.col("print").alias("p"), F.col("id").alias("i"), F.col("text_hash").alias("t"), "node")
    same = (F.col("print") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t"))
    own = full.join(named, same).select("node", "n", "bands", "sig").dropDuplicates(["node"])
    nodes = written(own, "near-nodes")

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    shared = cut(keyed.join(several, "key").select("key", "node"))
    label = F.coalesce("component", "node").alias("component")
    links = confirm(_alike(_star(shared), nodes))
    joined = components(links)
    rest = cut(_mixed(shared.join(joined, "node", "left").select("key", "node", label)))
    more = cut(links_between(rest, nodes, sets))
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    labelled = classes.join(joined, "node", "left").select("print", "id", "node", label)
    best = labelled.groupBy("component").agg(F.min("id").alias("component_id"), F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    out = labelled.join(best, "component").select("print", "id", "component_id", (F.col("node") == F.col("first")).alias("first"))
    return rows.select("id", "n", "print"), cut(out)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row."""
    rows, classes = near_classes(docs, id_col, text_col)
    joined = rows.join(classes.select("print", "component_id"), "print", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one per component, and all without words."""
    _, classes = near_classes(docs, id_col, text_col)
    print_col, schema = fresh(docs, "_print")[0], docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = [shingles((t.as_py() or "").encode(), known) for t in batch.column(at)]
            prints = [_fingerprint(f) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())], names=[*batch.schema.names, print_col])

    marked = docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField(print_col, T.BinaryType())]))
    p_col, i_col, hit_col, nth_col = fresh(marked, "_p", "_i", "_hit", "_nth")
    first = classes.where("first").select(F.col("print").alias(p_col), F.col("id").alias(i_col), F.lit(True).alias(hit_col))
    same = (F.col(print_col) == F.col(p_col)) & F.col(id_col).eqNullSafe(F.col(i_col))
    joined = marked.join(first, same, "left").where(F.col(hit_col) | F.col(print_col).isNull())
    # Rows without words all stay; of rows that repeat id and text, one does.
    nth = F.when(F.col(print_col).isNull(), F.monotonically_increasing_id())
    return joined.withColumn(nth_col, nth).dropDuplicates([id_col, print_col, nth_col]).select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    return near_groups(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op4_near_dedup": op4_near_dedup}
