"""Exact top-k search by integer inner product, with a dual-tree search over cover trees.

Vectors become ``floor(64 * x)``.  Data and queries are dealt into blocks by hash, and each block is indexed
once by a cover tree (centres of a level lie within half the radius of the level above).  A query block meets the data
blocks ``WAVE`` at a time; a task searches their trees together with its own, the most promising first, and carries the kth
scores from one to the next.  A pair of nodes is pruned when

    <q, x>  <=  <qc, xc> + rq * |xc| + rx * |qc| + rq * rx

is below the worst kth score of the query node's queries.  Each task returns at most k rows per query,
and a window merges them.  The queries are a stated set, so the work is queries times rows.

Equal vectors are cut before the search to the k + 1 smallest ids, at most k rows of each: no other can
be among the k best, as ties go to the smaller id and only a query's own id is skipped.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id,
take no part; vectors of another length than a query's are no candidates of it; rows of an id that repeats are
candidates each, but not of a query with that id; an empty table gives an empty result.  Components must stay below 2**20 or so in
magnitude, so that products are exact in double precision; a larger one raises.  Only the id and
vector columns are read, so clashing names of others do not matter.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import cut, ship, table

K = 20
LEAF = 512
BLOCK_ROWS = 4096
WAVE = 8  # data blocks of a task
EXACT = 2.0**53


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``id, vec`` with integer components, without the rows that take no part."""
    vec = F.col(vector_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(F.col(id_col).isNotNull() & vec.isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), scaled.alias("vec")
    )


@dataclass
class Node:
    """A node of a cover tree: all points below lie within ``radius`` of the centre."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """Centres are picked one after the other among points farther than half the radius from all before."""
    centre = points[rows[0]]
    distance = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
    radius = float(distance.max())
    node = Node(rows, centre, radius, float(np.sqrt(centre @ centre)))
    if len(rows) <= leaf or radius == 0:
        return node
    nearest, owner, reach = distance, np.zeros(len(rows), np.int64), radius / 2
    centres = 1
    while nearest[far := int(nearest.argmax())] > reach:
        away = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(axis=1))
        closer = away < nearest
        nearest, owner = np.where(closer, away, nearest), np.where(closer, centres, owner)
        centres += 1
        if centres >= max(8, 2 * len(rows) // leaf):  # in many dimensions points are far from each other: go on with the radius reached
            break
    for c in range(centres):
        below = rows[owner == c]
        if len(below) == len(rows):
            return node
        if len(below):
            node.children.append(cover_tree(points, below, leaf))
    return node


class _Best:
    """The k best (score, id) per query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(self.score[rows, -1].min())

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


@dataclass
class Indexed:
    """The vectors of a block, their ids, and their cover tree."""

    ids: np.ndarray
    points: np.ndarray
    tree: Node


def indexed(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Indexed:
    return Indexed(ids, points, cover_tree(points, np.arange(len(points)), leaf))


def bound(q: Node, x: Node) -> float:
    """The largest product of any two points below, and a hair more for what rounding may take from it."""
    b = float(q.centre @ x.centre) + q.radius * x.norm + x.radius * q.norm + q.radius * x.radius
    return b + 1e-9 * (abs(b) + 1)


def dual_tree(wanted: Indexed, data: Indexed, best: _Best) -> None:
    """Offer to ``best`` all points that belong to the exact k best by inner product, ties to the smaller id, without a query's own id."""
    queries, query_ids, points, ids = wanted.points, wanted.ids, data.points, data.ids

    def search(q: Node, x: Node) -> None:
        if bound(q, x) < best.worst(q.rows):
            return
        if not q.children and not x.children:
            score = queries[q.rows] @ points[x.rows].T
            score[query_ids[q.rows][:, None] == ids[x.rows]] = -np.inf
            # Only what may enter a list goes on; equal scores may, by a smaller id.
            hope = (score >= best.score[q.rows, -1:]) & (score > -np.inf)
            some, which = hope.any(axis=1), hope.any(axis=0)
            if some.any():
                part = np.where(hope, score, -np.inf)[some][:, which]
                own = np.where(part > -np.inf, ids[x.rows][which], np.iinfo(np.int64).max)
                best.offer(q.rows[some], part, own)
            return
        if x.children and (not q.children or x.radius >= q.radius):
            for _, child in sorted(((bound(q, c), n) for n, c in enumerate(x.children)), reverse=True):
                search(q, x.children[child])
        else:
            for child in q.children:
                search(child, x)

    search(wanted.tree, data.tree)


def _matrix(vectors: list[str], dim: int) -> np.ndarray:
    out = np.array([v.split(",") for v in vectors], np.float64) if dim else np.zeros((len(vectors), 0))
    if out.size and dim * float(np.abs(out).max()) ** 2 >= EXACT:
        raise ValueError("components are too large for exact products in double precision")
    return out


def _merged(wanted: Indexed, blocks: list[Indexed], k: int) -> _Best:
    """The k best of all blocks, those with the highest bound first."""
    best = _Best(len(wanted.ids), k)
    for data in sorted(blocks, key=lambda x: -bound(wanted.tree, x.tree)):
        dual_tree(wanted, data, best)
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` (``id, vec``; see :func:`usable`) to ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``id``.
    """
    ship(vectors.sparkSession)
    vectors = cut(vectors.withColumn("dim", F.size("vec")).withColumn("vec", F.array_join(F.transform("vec", lambda x: x.cast("bigint").cast("string")), ",")))
    # Equal vectors: the k + 1 smallest ids, found without bringing all copies together.
    salted = vectors.withColumn("copy", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    nth = F.row_number().over(Window.partitionBy("vec", "salt", "id").orderBy("copy"))
    few = salted.withColumn("c", nth).where(F.col("c") <= k)
    for same in (["vec", "salt"], ["vec"]):
        few = few.withColumn("r", F.dense_rank().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("r") <= k + 1)
    data = few.select("id", "dim", "vec")
    queries = vectors.where(is_query).select("id", "dim", "vec").dropDuplicates(["id", "vec"])
    n_data, n_query = vectors.count(), queries.count()
    data_blocks, query_blocks = max(1, -(-n_data // block_rows)), max(1, -(-n_query // block_rows))

    def packed(frame: DataFrame, blocks: int, key: str) -> DataFrame:
        """Blocks with their trees, built once."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            block, dim = int(pdf["block"].iloc[0]), int(pdf["dim"].iloc[0])
            whole = indexed(pdf["id"].to_numpy(np.int64), _matrix(list(pdf["vec"]), dim))
            return pd.DataFrame({key: [block], "dim": [dim], "blob": [pickle.dumps(whole, protocol=5)]})

        dealt = frame.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
        return dealt.select("block", "dim", "id", "vec").groupBy("block", "dim").applyInPandas(run, f"{key} int, dim int, blob binary")

    # Indexed blocks meet: each data block is sent to every query block, each query block to every wave of data blocks.
    waves = -(-data_blocks // WAVE)
    d = packed(data, data_blocks, "db").select(
        F.pmod("db", F.lit(waves)).alias("wave"), "dim", "blob", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(0).alias("side"))
    q = packed(queries, query_blocks, "qb").select(
        "qb", "dim", "blob", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))).alias("wave"), F.lit(1).alias("side"))
    columns = ["wave", "qb", "dim", "side", "blob"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks, wanted = ([pickle.loads(x) for x in pdf["blob"][pdf["side"] == side]] for side in (0, 1))
        rows: list[tuple] = []
        for one in wanted:  # one at most
            best = _merged(one, blocks, k)
            row, at = np.nonzero(best.id != np.iinfo(np.int64).max)
            rows.append((one.ids[row], best.id[row, at], best.score[row, at].astype(np.int64)))
        query_id, vec_id, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    partial = d.select(*columns).unionByName(q.select(*columns)).groupBy("wave", "qb", "dim").applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return top_k(usable(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)


ORACLE = {
    "op10_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
 FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
QUERIES = {"op10_topk_search": op10_topk_search}
