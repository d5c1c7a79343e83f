"""Operator 3, exact top-k inner-product search by dual trees.

Queries and data are indexed together: the top of the index is a set of pivots, fitted on a bounded sample, whose cells hold every vector; below it, each
task builds cover trees of its queries and its data. A pair of nodes is passed over when the highest inner product that their covering radii
allow is below the worst k-th score of the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, read_table, ship

TOP_K, SCALE, QUERY_EVERY = 20, 64, 20
#: Bounds: vectors that pivots and first thresholds come from, pivots, rows of a task's queries and data, rows of a leaf, children of a node.
SAMPLE, PIVOTS, QUERY_ROWS, DATA_ROWS, LEAF, FANOUT = 2048, 64, 1024, 4096, 256, 16
#: Scores that a task gathers before it keeps the best of each query.
POOL_ROWS = 200_000
_EXACT = 1 << 22


@dataclass
class Node:
    """A ball around ``center`` that covers ``rows``; leaves have no children."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)

    @property
    def reach(self) -> float:
        return float(np.sqrt(self.center @ self.center))


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Children's centers are points more than half the parent's radius apart, found farthest first (``FANOUT`` at most)."""
    rows = np.arange(len(x)) if rows is None else rows
    mean = x[rows].mean(axis=0)
    gap = ((x[rows] - mean) ** 2).sum(axis=1)
    center = x[rows[gap.argmin()]]
    near = ((x[rows] - center) ** 2).sum(axis=1)
    radius = float(np.sqrt(near.max()))
    node = Node(center, radius * (1 + 1e-9), rows)
    if len(rows) <= LEAF or radius == 0:
        return node
    owner = np.zeros(len(rows), np.int64)
    for k in range(1, FANOUT):
        far = int(near.argmax())
        if near[far] <= (radius / 2) ** 2:
            break
        to = ((x[rows] - x[rows[far]]) ** 2).sum(axis=1)
        closer = to < near
        owner[closer], near[closer] = k, to[closer]
    node.children = [cover_tree(x, part) for k in range(owner.max() + 1) if len(part := rows[owner == k])]
    return node


def bound(q: Node, d: Node) -> float:
    """No inner product between the two balls is above this."""
    return float(q.center @ d.center) + q.radius * d.reach + d.radius * q.reach + q.radius * d.radius


class Search:
    """The best k of a block of data for a block of queries; ``worst`` starts from scores that others are known to reach."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, worst: np.ndarray, k: int):
        order = np.argsort(d_ids, kind="stable")  # ties go to the smaller id, so to the smaller row
        self.q, self.q_ids, self.d, self.d_ids = q, q_ids, d[order], d_ids[order]
        self.worst, self.k = worst.astype(np.float64), k
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (query row, data row, score) that may be among the best
        self.held = 0
        self.exact = max(np.abs(q).max(initial=0), np.abs(d).max(initial=0)) < _EXACT

    def run(self) -> None:
        self._visit(cover_tree(self.q), cover_tree(self.d))
        self._settle()

    def _visit(self, q: Node, d: Node) -> None:
        if bound(q, d) < self.worst[q.rows].min():
            return
        if not q.children and not d.children:
            self._leaves(q.rows, d.rows)
        elif q.children and (not d.children or q.radius >= d.radius):
            for child in q.children:
                self._visit(child, d)
        else:
            for child in sorted(d.children, key=lambda c: -bound(q, c)):
                self._visit(q, child)

    def _leaves(self, qr: np.ndarray, dr: np.ndarray) -> None:
        scores = (self.q[qr] @ self.d[dr].T) if self.exact else (self.q[qr].astype(np.int64) @ self.d[dr].astype(np.int64).T).astype(np.float64)
        at, col = np.nonzero(scores >= self.worst[qr][:, None])
        own = self.q_ids[qr[at]] == self.d_ids[dr[col]]
        at, col = at[~own], col[~own]
        if len(at):
            self.pool.append((qr[at], dr[col], scores[at, col]))
            self.held += len(at)
            if self.held > POOL_ROWS:
                self._settle()

    def _settle(self) -> None:
        """Keeps the best k of each query in the pool and raises ``worst`` to the k-th of those that have k."""
        if not self.pool:
            return
        q, row, score = (np.concatenate(x) for x in zip(*self.pool, strict=True))
        order = np.lexsort((row, -score, q))
        q, row, score = q[order], row[order], score[order]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        full = rank == self.k - 1
        self.worst[q[full]] = np.maximum(self.worst[q[full]], score[full])
        best = rank < self.k
        self.pool, self.held = [(q[best], row[best], score[best])], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score)."""
        if not self.pool:
            none = np.zeros(0, np.int64)
            return none, none, none
        q, row, score = self.pool[0]
        return q, self.d_ids[row], score.astype(np.int64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first points of the sample: the top level of the cover tree."""
    if not len(sample):
        return sample
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _groups(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """cell -> (group, parts): small cells of like number share a group of about ``size`` rows, large ones have parts."""
    out, group, held, members = {}, 0, 0, []
    for cell in sorted(counts):
        if members and held + counts[cell] > size:
            group, held, members = group + 1, 0, []
        held += counts[cell]
        members.append(cell)
        out[cell] = group
    totals: dict[int, int] = {}
    for cell, g in out.items():
        totals[g] = totals.get(g, 0) + counts[cell]
    return {cell: (g, max(1, -(-totals[g] // size))) for cell, g in out.items()}


def top_k(vectors: DataFrame, is_query: Column, scratch: Scratch, *, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v array<long>): each query's k best inner products with other rows.

    Rows of the query's own vec_id take no part for it; exactly repeated rows count once. Vectors are compared with those of the most frequent length;
    others, and rows without vec_id, take no part. Fewer rows than k give fewer results; an empty table gives none. A task holds at most about
    ``QUERY_ROWS`` queries and ``DATA_ROWS`` vectors: a cell with more (one vector may hold a third of all) is dealt out by hash. What goes to the
    driver is the sample and one row a cell, which are bounded.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = scratch.store(vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").distinct().withColumn("q", is_query), "vectors")
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if lengths is None or not lengths["n"]:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("v") == lengths["n"])
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    seen, seen_ids = _matrix(sample["v"]), sample["vec_id"].to_numpy()
    pivots = _pivots(seen, PIVOTS)
    shared = spark.sparkContext.broadcast((seen, seen_ids, pivots))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, known_ids, tops = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"])
            to = np.maximum((x**2).sum(axis=1)[:, None] - 2 * (x @ tops.T) + (tops**2).sum(axis=1)[None], 0)
            cell = to.argmin(axis=1)
            away = np.sqrt(((x - tops[cell]) ** 2).sum(axis=1))
            # A query's k-th score within the sample is reached by its k-th score in all.
            worst, asks = np.full(len(x), -np.inf), pdf["q"].to_numpy(dtype=bool)
            if asks.any() and len(known) > k:
                s = x[asks] @ known.T
                s[pdf["vec_id"].to_numpy()[asks][:, None] == known_ids[None]] = -np.inf
                worst[asks] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            yield pdf.assign(cell=cell.astype(np.int32), away=away, worst=worst)

    placed = scratch.store(vectors.select("vec_id", "v", "q").mapInPandas(place, "vec_id long, v array<long>, q boolean, cell int, away double, worst double"), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.count_if("q").alias("nq"), F.max(F.when(F.col("q"), F.col("away"))).alias("rq"), F.min(F.when(F.col("q"), F.col("worst"))).alias("worst")).toPandas()
    if not cells["nq"].sum():
        return spark.createDataFrame([], schema)
    asked = cells[cells["nq"] > 0]
    data_of = _groups(dict(zip(cells["cell"].tolist(), cells["n"].tolist(), strict=True)), DATA_ROWS)
    query_of = _groups(dict(zip(asked["cell"].tolist(), asked["nq"].tolist(), strict=True)), QUERY_ROWS)
    balls = [Node(pivots[c], r * (1 + 1e-9), np.zeros(0)) for c, r in zip(cells["cell"], cells["r"], strict=True)]
    meet: set[tuple[int, int, int, int]] = set()
    for c, r, worst in zip(asked["cell"], asked["rq"], asked["worst"], strict=True):
        q = Node(pivots[c], r * (1 + 1e-9), np.zeros(0))
        for dc, ball in zip(cells["cell"].tolist(), balls, strict=True):
            if bound(q, ball) >= worst:
                meet.add((*query_of[c], *data_of[dc]))
    # At most PIVOTS x PIVOTS rows: which groups of cells meet, and in how many parts each is dealt out.
    pairs = F.broadcast(spark.createDataFrame(sorted(meet), "qg int, qparts int, dg int, dparts int"))
    group = F.broadcast(spark.createDataFrame([(c, g, query_of.get(c, (None, None))[0]) for c, (g, _) in data_of.items()], "cell int, dgroup int, qgroup int"))
    rows = placed.join(group, "cell")
    part = lambda parts: F.pmod(F.xxhash64("vec_id", F.lit(5), "v"), F.col(parts)).cast("int")
    asks = rows.where("q").join(pairs, F.col("qgroup") == F.col("qg")).withColumn("qpart", part("qparts")).withColumn("dpart", F.explode(F.sequence(F.lit(0), F.col("dparts") - 1)))
    gives = rows.join(pairs, F.col("dgroup") == F.col("dg")).withColumn("dpart", part("dparts")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    keys = ["qg", "qpart", "dg", "dpart"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        s = Search(_matrix(left["v"]), left["vec_id"].to_numpy(), _matrix(right["v"]), right["vec_id"].to_numpy(), left["worst"].to_numpy(), k)
        s.run()
        at, ids, score = s.found()
        return pd.DataFrame({"query_id": left["vec_id"].to_numpy()[at], "vec_id": ids, "score": score})

    # New names: both sides come from one table.
    left = asks.select(*keys, "vec_id", "v", "worst").toDF("a", "b", "c", "d", "vec_id", "v", "worst")
    right = gives.select(*keys, "vec_id", "v").toDF("e", "f", "g", "h", "vec_id", "v")
    found = left.groupBy("a", "b", "c", "d").cogroup(right.groupBy("e", "f", "g", "h")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every vector whose id is divisible by 20."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % QUERY_EVERY == 0, Scratch(spark, "search"))


OP3_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
