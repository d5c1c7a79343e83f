"""Operator 9, best-fit packing under conflicts.

Texts are cut into pieces of at most one sequence and packed into sequences (bins). Bins are kept in the order of their residual room. A bin carries
bitmaps of the sources and duplicate clusters that it holds; the search for a bin starts at the tightest one with room
and goes on to its successors until one is compatible.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, n_words, own, read_table, ship, text_or_empty

CAPACITY, SHARD_PIECES, MAX_PER_SOURCE = 2048, 4096, 2


class Bins:
    """Open bins by residual room, with bitmaps; ``place`` gives (bin, offset).

    A bin's k-th layer has the bits of the sources that it holds k + 1 times or more, so the last layer those that are full;
    ``clusters`` has the bits of the duplicate clusters in it.
    A run of pieces of equal size, source and cluster goes on where the last search ended: bins passed over stay incompatible for it.
    """

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.most = capacity, max_per_source
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: a bin has r room
        self.room: list[int] = []
        self.layers: list[list[int]] = []
        self.clusters: list[int] = []
        self.last: tuple[int, int, int] | None = None
        self.resume: tuple[int, int] = (0, 0)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """``source`` and ``cluster`` are single-bit masks; cluster 0 conflicts with none."""
        run = (size, source, cluster)
        r, i = self.resume if run == self.last else (size, 0)
        self.last = run
        while True:
            later = self.rooms >> r
            if not later:
                return self._new(run)
            skip = (later & -later).bit_length() - 1
            if skip:
                r, i = r + skip, 0
            at = self.by_room[r]
            while i < len(at):
                b = at[i]
                if not self.clusters[b] & cluster and not self.layers[b][-1] & source:
                    return self._put(b, r, i, run)
                i += 1
            r, i = r + 1, 0
            if r > self.capacity:
                return self._new(run)

    def _mark(self, b: int, source: int, cluster: int) -> None:
        self.clusters[b] |= cluster
        for k in range(self.most):
            if not self.layers[b][k] & source:
                self.layers[b][k] |= source
                return

    def _put(self, b: int, r: int, i: int, run: tuple[int, int, int]) -> tuple[int, int]:
        size, source, cluster = run
        at = self.by_room[r]
        at[i] = at[-1]
        at.pop()
        if not at:
            self.rooms &= ~(1 << r)
        self.resume = (r, i)
        self._open(b, r - size)
        self._mark(b, source, cluster)
        return b, self.capacity - r

    def _open(self, b: int, room: int) -> None:
        self.room[b] = room
        if room:
            self.by_room[room].append(b)
            self.rooms |= 1 << room

    def _new(self, run: tuple[int, int, int]) -> tuple[int, int]:
        size, source, cluster = run
        b = len(self.room)
        self.room.append(0)
        self.layers.append([0] * self.most)
        self.clusters.append(0)
        self.resume = (self.capacity + 1, 0)
        self._open(b, self.capacity - size)
        self._mark(b, source, cluster)
        return b, 0


def pack_shard(pieces: pd.DataFrame, capacity: int, max_per_source: int) -> pd.DataFrame:
    """Bin and offset for each row (words, source, cluster), larger ones first; equal ones of a kind in a row."""
    order = pieces.sort_values(["words", "cluster", "source", "doc_id", "start"], ascending=[False, True, True, True, True], na_position="first", kind="stable")
    sources = {s: 1 << i for i, s in enumerate(order["source"].astype(object).where(order["source"].notna(), None).unique())}
    twice = order["cluster"].value_counts()
    clusters = {c: 1 << i for i, c in enumerate(twice[twice > 1].index)}
    bins, where = Bins(capacity, max_per_source), []
    named = order["source"].astype(object).where(order["source"].notna(), None)
    for size, source, cluster in zip(order["words"].tolist(), named.tolist(), order["cluster"].tolist(), strict=True):
        where.append(bins.place(size, sources[source], clusters.get(cluster, 0)))
    return order.assign(bin=[b for b, _ in where], offset=[o for _, o in where])


def pack(df: DataFrame, *, size: Column, cluster: Column, scratch: Scratch, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, max_per_source: int = MAX_PER_SOURCE) -> DataFrame:
    """Where each piece of each document goes: (doc_id, start, words, shard, bin, offset).

    A document longer than a sequence is cut at multiples of ``capacity``; no word is lost. Two pieces of one duplicate cluster (unless
    of the same document's cut, whose whole pieces fill a bin alone) or more than ``max_per_source`` of one source never share a bin. Pieces
    are dealt by hash of their place into shards of about ``shard_pieces`` rows, each packed by one task: a hot source or
    group of copies spreads over all shards, and what a task holds is bounded. Bins belong to their shard.

    Documents without words (null or empty text) are listed with 0 words and null bin. Repeated rows are packed each; a null
    source is a source of its own. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    v, c = own("words"), own("cluster")
    rows = df.select("doc_id", "source", size.cast("long").alias(v), cluster.alias(c))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col(v) - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = rows.select("doc_id", "source", F.col(c).alias("cluster"), v, F.explode(starts).alias("start"))
    pieces = pieces.select("doc_id", "source", "cluster", "start", F.least(F.col(v) - F.col("start"), F.lit(capacity)).alias("words"), F.monotonically_increasing_id().alias("place"))
    pieces = scratch.store(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.where("words > 0").withColumn("shard", F.pmod(F.xxhash64("place", F.lit(9)), F.lit(shards)).cast("int"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, capacity, max_per_source)[["doc_id", "start", "words", "shard", "bin", "offset"]]

    placed = dealt.groupBy("shard").applyInPandas(packed, "doc_id long, start long, words long, shard int, bin long, offset long")
    nothing = pieces.where("words = 0").select("doc_id", "start", "words", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(nothing)


def copies_of(text: Column) -> Column:
    """The duplicate cluster of exact copies."""
    return F.xxhash64(text_or_empty(text))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, size=n_words(F.col("text")), cluster=copies_of(F.col("text")), scratch=Scratch(spark, "pack"))
