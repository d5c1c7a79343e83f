"""Operator 2, n-gram Jaccard join by count vectors in R-trees.

A document is the set of its word shingles. Shingles are hashed into groups, and the group counts are a document's point. The sum over the groups of
the smaller count bounds the overlap of two sets, and that of the upper corners of two boxes bounds it for all their points: R-trees over the points pass over
all pairs that cannot reach the threshold. Survivors are verified on the whole sets.

What meets in one tree: by size, documents share a band with all that can link with them. In a band at most d shingles differ between linked
sets, so if the shingles are dealt into d + 1 + spare blocks, linked sets agree on the whole content of 1 + spare of them or more, and each leaves out its spare
lightest blocks in an order that both share. A tree holds the sets that agree on one block (a cell). That is exact: no link is lost.

Two rounds of trees keep every step in proportion to the documents. The first works on the points alone and gives, of each cell, a forest of the pairs whose
bound reaches the threshold; its components are clusters outside of which no document has a link. The second gets the whole sets of a cluster, verifies
surviving pairs in the task and unites documents as links are found, so that it gives a forest, and pairs of one component are passed over.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import Scratch, own, read_table, ship, text_or_empty
from taktwerk.llm.graph import components

#: Groups of the count vectors that cells are joined by, of those that whole sets are, and of those that split clusters too large for one group; size ratio of a band.
GROUPS, FINE_GROUPS, FINEST_GROUPS, BAND = 64, 256, 1024, 1.5
#: Blocks beyond those that can differ: this share of them, but SPARE at least.
SPARE, SPARE_SHARE = 2, 0.25
#: Points of a leaf; members of a cell, and documents and bytes of a cluster, that one task takes at most (larger ones are dealt out as pairs of parts).
LEAF, CELL_ROWS, CLUSTER_ROWS, CLUSTER_BYTES = 64, 4096, 512, 16 << 20
#: Documents of a dealt-out cluster that all its parts hold, so that the parts' components meet.
ANCHORS = 16
#: Mean shingles of a cluster's sets from which points of GROUPS no longer tell unlike sets apart.
LONG_SET = 512
#: Cells of a 0/1 matrix by which overlaps are counted together.
MATRIX = 8_000_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_FULL = 0xFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; words are lower-cased in A-Z. Fewer words are one shingle, none is an empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    ids = np.array([h(w) for w in words], np.uint64)
    width = min(n, len(ids))
    key = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        key = _mix(key * _A + ids[k : len(ids) - width + 1 + k])
    return np.unique(key)


def signature(s: np.ndarray) -> int:
    """One signed 64-bit name for a set."""
    parts = np.array([np.add.reduce(_mix(s ^ _A)), np.bitwise_xor.reduce(_mix(s ^ _D)), len(s)], np.uint64)
    return int(_mix(_mix(_mix(parts[:1]) + parts[1]) + parts[2]).view(np.int64)[0])


def count_vector(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles of each group, as bytes; the highest stands for itself and all above."""
    return np.minimum(np.bincount((s >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups), _FULL).astype(np.uint8)


def points_of(vectors: np.ndarray) -> np.ndarray:
    """Vectors as numbers to take minima of: bytes, or where one is full wider numbers with no bound in its place."""
    return np.where(vectors == _FULL, 1 << 40, vectors.astype(np.int64)) if (vectors == _FULL).any() else vectors


class Bands:
    """Sizes by band, and the cells of a set, for links of num / den similarity or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))

    def linked(self, a: np.ndarray, b: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b with this overlap (or bound of it) link."""
        return self.den * overlap >= self.num * (a + b - overlap)

    def differ(self, band: int) -> int:
        """The most shingles in which two linked sets of a band differ."""
        return 2 * (self.edges[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def cells(self, s: np.ndarray) -> np.ndarray:
        """Names of the cells of a set. The spare lightest blocks are left out: by size, then content, so that of the blocks which two linked sets agree on one is kept by both."""
        size, out = len(s), []
        home = bisect_right(self.edges, size) - 1
        for band in (home, home + 1):
            if band > home and size * self.den < self.num * self.edges[band]:
                continue
            if not (d := self.differ(band)):
                continue
            spare = max(SPARE, int(d * SPARE_SHARE))
            blocks = d + 1 + spare
            at = (_mix(s + _C) % np.uint64(blocks)).astype(np.int64)
            held = np.bincount(at, minlength=blocks)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(held)
            sums = np.zeros(blocks, np.uint64)
            some = held > 0
            sums[some] = np.add.reduceat(_mix(s[order] ^ _B), (ends - held)[some])
            names = _mix(_mix(sums + np.array([band], np.uint64) * _A) + np.arange(blocks, dtype=np.uint64) * _D)
            out.append(names[np.lexsort((sums, held))[spare:]])
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


class RTree:
    """Sort-tile packed boxes over (size, group counts) points: the least size and the upper corner of each."""

    def __init__(self, size: np.ndarray, points: np.ndarray, rows: np.ndarray, axis: int = 0):
        self.rows, self.low = rows, int(size[rows].min())
        self.corner = points[rows].max(axis=0)
        self.children: list[RTree] = []
        if len(rows) > LEAF:
            by = size[rows] if axis == 0 else points[rows, axis - 1]
            order = rows[np.argsort(by, kind="stable")]
            self.children = [RTree(size, points, part, (axis + 1) % (points.shape[1] + 1)) for part in np.array_split(order, 4) if len(part)]


class Forest:
    """Unites the rows of a group along pairs that link; ``edges`` are the pairs that united two components."""

    def __init__(self, size: np.ndarray, points: np.ndarray, bands: Bands, roots: np.ndarray | None = None, overlaps: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """``roots`` numbers the components so far; ``overlaps`` gives the true overlaps of rows with rows, without it the bound decides."""
        self.size, self.points, self.bands, self.overlaps = size, points, bands, overlaps
        self.roots = np.arange(len(size)) if roots is None else roots.copy()
        self.edges: list[tuple[int, int]] = []

    def join(self, left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
        """All rows of ``left`` with each other, or with those of ``right``."""
        a = RTree(self.size, self.points, left)
        todo = [(a, a if right is None else RTree(self.size, self.points, right))]
        while todo:
            a, b = todo.pop()
            ra, rb = self.roots[a.rows], self.roots[b.rows]
            if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == rb[0]).all():
                continue
            if not self.bands.linked(a.low, b.low, int(np.minimum(a.corner, b.corner).sum(dtype=np.int64))):
                continue
            if a is b and a.children:
                todo += [(x, y) for i, x in enumerate(a.children) for y in a.children[i + 1 :]] + [(x, x) for x in a.children]  # a box with itself first
            elif a.children and (not b.children or len(a.rows) >= len(b.rows)):
                todo += [(x, b) for x in a.children]
            elif b.children:
                todo += [(a, y) for y in b.children]
            else:
                self._leaves(a.rows, b.rows, a is b)
        return self.edges

    def _leaves(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        bound = np.minimum(self.points[a][:, None], self.points[b][None]).sum(axis=2, dtype=np.int64)
        good = self.bands.linked(self.size[a][:, None], self.size[b][None], bound) & (self.roots[a][:, None] != self.roots[b][None])
        if same:
            good = np.triu(good, 1)
        if self.overlaps is not None and good.any():
            i, j = np.nonzero(good.any(axis=1))[0], np.nonzero(good.any(axis=0))[0]
            some = np.ix_(i, j)
            good[some] &= self.bands.linked(self.size[a[i]][:, None], self.size[b[j]][None], self.overlaps(a[i], b[j]))
        while good.any():
            i, j = divmod(int(good.argmax()), len(b))
            x, y = int(a[i]), int(b[j])
            self.edges.append((x, y))
            self.roots[self.roots == self.roots[y]] = self.roots[x]
            good &= self.roots[a][:, None] != self.roots[b][None]


def overlaps_of(sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The function from two lists of rows to the sizes of the intersections of their sets."""

    def count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = [sets[i] for i in a], [sets[j] for j in b]
        if len(a) * len(b) > 4:
            xs, ys = np.concatenate(x), np.concatenate(y)
            both = np.intersect1d(xs, ys)
            if len(both) and max(len(a), len(b)) * len(both) <= MATRIX:
                held = []
                for parts, every in ((x, xs), (y, ys)):
                    at = np.minimum(np.searchsorted(both, every), len(both) - 1)
                    hit = both[at] == every
                    m = np.zeros((len(parts), len(both)), np.float32)
                    m[np.repeat(np.arange(len(parts)), [len(p) for p in parts])[hit], at[hit]] = 1
                    held.append(m)
                return np.rint(held[0] @ held[1].T).astype(np.int64)
        return np.array([[len(np.intersect1d(p, q, assume_unique=True)) for q in y] for p in x], np.int64)

    return count


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows in the order of their first ``keys`` columns: tables of whole groups, and where the groups begin and end."""

    def given(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.concatenate([[0], _changes(t, keys), [t.num_rows]])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and last != tuple(batch.column(k)[0].as_py() for k in range(keys)):
            yield given(held)
            held = []
        last = tuple(batch.column(k)[-1].as_py() for k in range(keys))
        at = _changes(batch, keys)
        if len(at):
            yield given([*held, batch.slice(0, at[-1])])
            held = []
            batch = batch.slice(at[-1])
        held.append(batch)
    if held:
        yield given(held)


def _changes(rows: pa.RecordBatch | pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in range(keys):
        x = rows.column(k).to_numpy() if isinstance(rows, pa.Table) else rows.column(k).to_numpy(zero_copy_only=False)
        new |= x[1:] != x[:-1]
    return np.nonzero(new)[0] + 1


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _digest(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(doc_id, mark, node, n, counts, cells): the text's hash, and its set's name, size, count vector and cells. Within a task a set's cells are given once."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, size, counts, cells = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, n)
                name = signature(s) if len(s) else None
                node.append(name)
                size.append(len(s))
                counts.append(count_vector(s).tobytes() if len(s) else None)
                cells.append(None if name is None or name in seen else bands.cells(s))
                if name is not None:
                    seen.add(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(counts, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], names=["doc_id", "mark", "node", "n", "counts", "cells"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"), F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(digest, "doc_id long, mark long, node long, n long, counts binary, cells array<long>")


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (cell, node): those of cells with two nodes or more. Equal rows count once."""
    last_cell = last_node = center = None  # center: the cell's first node
    single = False  # the last row is its cell's first and has not been given
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        first = np.concatenate([[cell[0] != last_cell], cell[1:] != cell[:-1]])
        fresh = first | np.concatenate([[node[0] != last_node], node[1:] != node[:-1]])
        cell, node, first = cell[fresh], node[fresh], first[fresh]
        if not len(cell):
            continue
        start = np.maximum.accumulate(np.where(first, np.arange(len(cell)), -1))
        middle = np.where(start >= 0, node[np.maximum(start, 0)], 0 if center is None else center)
        second = ~first & np.concatenate([[single], first[:-1]])
        out = [np.concatenate([x[~first], y[second]]) for x, y in ((cell, cell), (node, middle))]
        last_cell, last_node, center, single = cell[-1], node[-1], middle[-1], bool(first[-1])
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["cell", "node"])


def _dealt(df: DataFrame, chunks: str, chunk: str) -> DataFrame:
    """Each row to every pair (i, j) of parts that its part is in."""
    other = F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)).alias("other")
    return df.select("*", other).withColumns({"i": F.least(chunk, "other"), "j": F.greatest(chunk, "other")}).drop("other")


def _clusters(members: DataFrame, sized: DataFrame, bands: Bands, scratch: Scratch) -> DataFrame:
    """(node, component): nodes joined by a chain of pairs that share a cell and whose bound reaches the threshold."""
    # Cells with the same members are joined once.
    spans = members.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("node")).alias("sign")).where("held > 1").groupBy("sign", "held").agg(F.min("cell").alias("cell"))
    rows = members.join(spans.select("cell", F.ceil(F.col("held") / CELL_ROWS).cast("int").alias("chunks")), "cell").join(sized, "node")
    dealt = _dealt(rows.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")), "chunks", "chunk").select("cell", "i", "j", "chunk", "node", "n", "counts")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 3):
            i, j, side, node, size = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            points = points_of(_vectors(t.column(6)))
            held = np.diff(at)
            two = at[:-1][held == 2]
            two = two[(i[two] == j[two]) | (side[two] != side[two + 1])]
            bound = np.minimum(points[two], points[two + 1]).sum(axis=1, dtype=np.int64)
            good = two[bands.linked(size[two], size[two + 1], bound)]
            a, b = [node[good]], [node[good + 1]]
            for k in np.nonzero(held > 2)[0].tolist():
                rows = np.arange(at[k], at[k + 1])
                f, inside = Forest(size[rows], points[rows], bands), np.arange(len(rows))
                if i[rows[0]] == j[rows[0]]:
                    f.join(inside)
                else:
                    left = side[rows] == i[rows[0]]
                    if left.any() and not left.all():
                        f.join(inside[left], inside[~left])
                if f.edges:
                    x, y = rows[np.array(f.edges)].T
                    a.append(node[x])
                    b.append(node[y])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    pairs = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(forests, "a long, b long")
    return components(pairs, scratch)


def _with_sets(need: DataFrame, docs: DataFrame, n: int, columns: list[str], blob: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """``columns`` of (node, rep, ...) with the whole set ``held`` of each node (or what ``blob`` makes of it), made again from the text of one document."""
    k = len(columns)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(k).to_pylist(), strict=True):
                s = shingle_set(text, n)
                keep.append(len(s) > 0 and signature(s) == name)
                if keep[-1]:
                    held.append(blob(s))
            kept = pa.RecordBatch.from_arrays(batch.columns[:k], names=columns).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(held, pa.binary())], names=[*columns, "held"])

    texts = docs.select(F.col("doc_id").cast("long").alias(own("id")), text_or_empty(F.col("text")).alias(own("text"))).join(need, F.col(own("id")).eqNullSafe(F.col("rep")))
    schema = ", ".join(f"{c} {kind}" for c, kind in need.select(*columns).dtypes)
    return texts.select(*columns, own("text")).mapInArrow(sets, f"{schema}, held binary")


def _linked(dealt: DataFrame, bands: Bands) -> DataFrame:
    """A forest (a, b) of the links of each group (cluster, i, j) of (.., part, node, comp, held): between its parts i and j, or within i."""

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 3):
            i, j, part, nodes, comps = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            blobs, a, b = t.column(6).combine_chunks() if t.column(6).num_chunks != 1 else t.column(6).chunk(0), [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                _, first = np.unique(np.stack([nodes[lo:hi], part[lo:hi]]), axis=1, return_index=True)  # a document may stand for its node more than once
                rows = lo + np.sort(first)
                if len(rows) < 2:
                    continue
                sets = [np.frombuffer(blobs[r].as_buffer(), np.uint64) for r in rows.tolist()]
                size = np.array([len(s) for s in sets])
                points = points_of(np.stack([count_vector(s, FINE_GROUPS) for s in sets]))
                f, inside = Forest(size, points, bands, np.unique(comps[rows], return_inverse=True)[1], overlaps_of(sets)), np.arange(len(rows))
                if i[lo] == j[lo]:
                    f.join(inside)
                else:
                    left = part[rows] == i[lo]
                    if left.any() and not left.all():
                        f.join(inside[left], inside[~left])
                a += [nodes[rows[x]] for x, _ in f.edges]
                b += [nodes[rows[y]] for _, y in f.edges]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    return dealt.select("cluster", "i", "j", "part", "node", "comp", "held").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(forests, "a long, b long")


def _parts(rows: str, weight: str) -> Column:
    """How many parts so many sets of so many shingles are dealt into."""
    return F.greatest(F.ceil(F.col(rows) / CLUSTER_ROWS), F.ceil(F.col(weight) * 8 / CLUSTER_BYTES)).cast("int")


def _links(clusters: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, bands: Bands, scratch: Scratch) -> DataFrame:
    """(node, component) by the links that hold for whole sets. A cluster is verified in one group, or if it is too large in parts: first within each
    part, with some anchors that all parts hold, then what is not in the cluster's largest component against all else."""
    need = nodes.join(clusters, "node").select("node", "rep", "n", F.col("component").alias("cluster"))
    spans = need.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    need = need.join(spans.withColumn("parts", _parts("rows", "weight")), "cluster")
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    anchor = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(4)), F.col("rows")) < ANCHORS)
    need = need.select("node", "rep", "n", "cluster", "parts", F.when(anchor, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part)).alias("at"))
    need = scratch.store(need, "need")
    first = _with_sets(need, docs, n, ["node", "cluster", "at"]).select("cluster", F.explode("at").alias("i"), "node", "held")
    comp = components(_linked(first.select("cluster", "i", F.col("i").alias("j"), F.col("i").alias("part"), "node", F.col("node").alias("comp"), "held"), bands), scratch)
    large = need.where("parts > 1").drop("at", "parts")
    if not large.isEmpty():
        named = scratch.store(large.join(comp, "node", "left").select("node", "rep", "n", "cluster", F.coalesce("component", "node").alias("comp")), "named")
        most = named.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"))
        rest = F.col("comp") != F.col("most")
        sized = named.join(most, "cluster").groupBy("cluster").agg(*[f(F.when(side, x)).alias(name) for side, k in ((rest, "r"), (~rest, "l")) for f, x, name in ((F.count, F.lit(1), f"{k}_rows"), (F.sum, F.col("n"), f"{k}_n"))])
        sized = sized.where("r_rows > 0").select("cluster", _parts("r_rows", "r_n").alias("r"), _parts("l_rows", "l_n").alias("l"))
        part = F.when(rest, F.pmod(F.xxhash64("node", F.lit(5)), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("node", F.lit(5)), F.col("l"))).cast("int")
        need2 = scratch.store(named.join(most, "cluster").join(sized, "cluster").select("node", "rep", "n", "cluster", "comp", part.alias("part"), F.when(rest, F.col("r") + F.col("l")).otherwise(F.col("r")).alias("others")), "rest")
        second = _dealt(_with_sets(need2, docs, n, ["node", "cluster", "comp", "part", "others"]), "others", "part")
        comp = components(comp.toDF("a", "b").unionByName(_linked(second, bands)), scratch)
        scratch.drop(named, need2)
    scratch.drop(need)
    return comp


def _split(clusters: DataFrame, members: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, bands: Bands, scratch: Scratch) -> DataFrame:
    """``clusters`` with those of long sets, and those that are too large for one group, joined anew by their cells, on points of more groups: on few groups the
    bounds of any two long sets reach the threshold, so that unlike ones end in one cluster. No link is lost, as the new bounds hold as well."""
    need = nodes.join(clusters, "node").select("node", "rep", "n", "component")
    large = need.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")).where((F.col("weight") >= LONG_SET * F.col("rows")) | (_parts("rows", "weight") > 1)).select("component")
    wide = scratch.store(need.join(large, "component").select("node", "rep", "n"), "wide")
    if wide.isEmpty():
        scratch.drop(wide)
        return clusters
    points = _with_sets(wide, docs, n, ["node", "n"], lambda s: count_vector(s, FINEST_GROUPS).tobytes())
    points = scratch.store(points.groupBy("node", "n").agg(F.first("held").alias("counts")), "points")
    finer = _clusters(members.join(wide.select("node"), "node"), points, bands, scratch)
    out = scratch.store(clusters.join(wide.select("node"), "node", "left_anti").select("node", "component").unionByName(finer.select("node", "component")), "clusters")
    scratch.drop(wide, points)
    return out


def near_components(docs: DataFrame, scratch: Scratch, *, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, mark, component) of each row of (doc_id, text): sets link when den * intersection >= num * union.

    Equal sets are one node. Cells of more than ``CELL_ROWS`` members and clusters of more than ``CLUSTER_ROWS`` documents or ``CLUSTER_BYTES`` are dealt out as
    pairs of parts, so that every pair meets and no task holds more. The result is the components; links inside a component are not listed.

    Null and empty texts, and texts without words, have an empty set, link with nothing and are their own component (``component``, its
    inner name, is null). Repeated rows link. Rows with null doc_id keep a place but name a component only if all its rows are null.
    ``mark`` is a hash of the text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    bands = Bands(num, den)
    digest = scratch.store(_digest(docs, n, bands), "digest")
    nodes = scratch.store(digest.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("counts").alias("counts")), "nodes")
    cells = digest.where("cells IS NOT NULL").select(F.explode("cells").alias("cell"), "node").repartition("cell").sortWithinPartitions("cell", "node")
    members = scratch.store(cells.mapInArrow(_shared_cells, "cell long, node long"), "members")
    del cells
    scratch.release()
    clusters = _clusters(members, nodes.select("node", "n", "counts"), bands, scratch)
    clusters = _split(clusters, members, nodes, docs, n, bands, scratch)
    scratch.drop(members)
    scratch.release()
    final = _links(clusters, nodes, docs, n, bands, scratch).toDF("node", "comp")
    scratch.drop(nodes)
    scratch.release()

    rows = digest.select("doc_id", "mark", "n", "node").join(final, "node", "left").select("doc_id", "mark", "n", F.coalesce("comp", "node").alias("comp"))
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias(own("least")))
    out = rows.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own("least"), "doc_id").alias("component_id"), "mark", F.col("comp").alias("component"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents at three words and 90 %."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_components(docs, Scratch(spark, "ngrams")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with one of each component of near copies: that of smallest doc_id, then text hash; null ids come last.

    Rows with empty sets all stay. Of rows equal in doc_id and text one stays."""
    groups = near_components(docs, scratch, n=n, num=num, den=den)
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias(own("id")), F.col("x.mark").alias(own("mark")))
    empty = docs.where(~text_or_empty(F.col("text")).rlike(r"[^\x20\x09-\x0D]"))
    held = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own("id"))) & (F.xxhash64("text") == F.col(own("mark"))))
    return held.dropDuplicates([own("id"), own("mark")]).select(*docs.columns).unionByName(empty)
