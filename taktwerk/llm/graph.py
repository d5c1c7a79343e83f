"""Connected components of a table of links: each task unites its own links, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch

#: Links that a task gets, about, and that it unites at a time; the tasks of a step at least.
TASK_LINKS, TASKS = 1 << 17, 4


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars: every node but the smallest of its component, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        m = np.minimum(least[x], least[y])
        after = least.copy()
        # The roots of both ends are tied to the lesser one, then every node to its root's root.
        np.minimum.at(after, least[x], m)
        np.minimum.at(after, least[y], m)
        while (after[after] != after).any():
            after = after[after]
        if (after == least).all():
            break
        least = after
    tied = least != np.arange(len(nodes))
    return nodes[tied], nodes[least[tied]]


def _united_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def given() -> pa.RecordBatch:
        out = united(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= TASK_LINKS:
            yield given()
            held = []
    if held:
        yield given()


def _least(of: Column | str, key: str) -> Column:
    return F.min(of).over(Window.partitionBy(key))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours. As many rows as ``e`` at most."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    return both.select("u", "v", F.least("u", _least("v", "u")).alias("m")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them; the row of that one ties the node itself."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return down.select("u", "v", _least("v", "u").alias("m")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def _odd_nodes(e: DataFrame) -> DataFrame:
    """Nodes that are tied to two others, or tied and tied to: without any, all links are stars."""
    ends = e.select(F.col("a").alias("node"), "b", F.lit(None).cast("long").alias("below")).union(e.select("b", F.lit(None).cast("long"), "a"))
    seen = ends.groupBy("node").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.max("below").alias("below"))
    return seen.where("least <> most OR (least IS NOT NULL AND below IS NOT NULL)")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of the links (a, b); the component is its smallest node.

    A task unites a bounded number of links by itself; what the tasks tell of shared nodes is then settled by stars, each a shuffle by node,
    so none gathers a component or the table in a task. The rounds grow with the logarithm of the longest chain. Tables are stored each round, so the plans stay short.
    The links decide how many tasks a step has, as a table of links is far smaller than what it was found in.
    """
    found = scratch.store(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "links")
    tasks = max(TASKS, -(-found.count() // TASK_LINKS))
    now = scratch.store(found.coalesce(tasks).mapInArrow(_united_in_tasks, "a long, b long"), "stars")
    scratch.drop(found)
    while _odd_nodes(now).coalesce(tasks).count():
        after = scratch.store(_small_star(_large_star(now).coalesce(tasks)).coalesce(tasks).distinct().coalesce(tasks), "stars")
        scratch.drop(now)
        now = after
    # With the roots; a star that is settled at once may be told by several tasks.
    every = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x"))
    out = scratch.store(every.select("x.node", "x.component").distinct().coalesce(tasks), "components")
    scratch.drop(now)
    return out
