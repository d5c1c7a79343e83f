"""Isolation forests, one a key: trees of random cuts, each over its own draw of a key's rows, kept as a table of nodes that rows are walked along.

Everything random is read from SHA-256 of (seed, key, tree, node), so a rerun, another engine or another partitioning builds the same trees.
Node ids are those of a heap: the root is 1, the children of n are 2 n (below the cut) and 2 n + 1.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions.shipping import ship

EULER = 0.5772156649
NODES = "tree int, node int, feature int, cut double, path double"


@dataclass(frozen=True)
class ForestSpec:
    """Trees a key; rows of a key that trees draw from, at most (None: all); rows of a tree, at most; rows below which a key gets no forest; seed.

    The rows of a tree are part of the method (256 by default in the reference's forests as well, as depth and scores rest on them); the pool is not."""

    trees: int = 200
    pool: int | None = 1024
    sample: int = 256
    least: int = 30
    seed: int = 0

    @property
    def depth(self) -> int:
        return max(1, math.ceil(math.log2(self.sample)))


def expected_path(n: float) -> float:
    """Mean path of an unsuccessful search among ``n`` rows: what a leaf of ``n`` rows would still need."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _draw(*parts: Column) -> Column:
    """A hash of the parts that orders rows."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def _first(df: DataFrame, by: list[str], order: Column, n: int, salts: int = 16) -> DataFrame:
    """The ``n`` rows of each group that come first by ``order`` (a hash): first within salted parts, then of what is left, so that no task sorts a whole group."""
    d = df.withColumn("__o", order)
    part = F.pmod(F.xxhash64("__o"), F.lit(salts))
    d = d.withColumn("__s", part).withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__o"))).where(F.col("__r") <= n)
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__o"))).where(F.col("__r") <= n)
    return d.drop("__o", "__s", "__r")


def _number(*parts: Column) -> Column:
    """The first 60 bits of ``_draw``."""
    return F.conv(F.substring(_draw(*parts), 1, 15), 16, 10).cast("long")


def draw_from_all(df: DataFrame, key: str, row: str, features: list[str], spec: ForestSpec) -> DataFrame:
    """(key, tree, __n, row, features...): what each tree draws from all ``__n`` rows of its key, without repeats.

    A key's rows stand in the order of a hash. That order is cut into as many equal stretches as a tree has rows, and each tree picks one row of every stretch by a hash of
    its own, so any row may be drawn by any tree and no row is hashed once a tree. Rows are numbered within 4,096 parts of the order, so no task sorts a whole key.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, row, *features, _number(F.col(key), F.col(row)).alias("__o")).withColumn("__part", F.shiftright("__o", 48))
    ahead = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))
    parts = parts.select(key, "__part", F.sum("__c").over(Window.partitionBy(key)).alias("__n"), (F.sum("__c").over(ahead) - F.col("__c")).alias("__before")).where(F.col("__n") >= spec.least)
    n, j, size = F.col("__n"), F.col("__j"), F.least(F.lit(spec.sample), F.col("__n"))
    draws = parts.groupBy(key).agg(F.max("__n").alias("__n")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(spec.trees - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    draws = draws.withColumns({"__lo": F.floor(n * j / size), "__hi": F.floor(n * (j + 1) / size)})
    place = F.col("__lo") + _number(F.lit(spec.seed), F.col(key), F.col("tree"), F.lit("row"), j) % (F.col("__hi") - F.col("__lo"))
    # A draw falls into the last part that begins at or before its place.
    begins = parts.select(key, "__n", F.lit(None).cast("int").alias("tree"), F.col("__before").alias("__place"), "__part", "__before")
    begins = begins.unionByName(draws.select(key, "__n", "tree", place.alias("__place")), allowMissingColumns=True)
    along = Window.partitionBy(key).orderBy("__place", F.col("tree").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = begins.withColumns({c: F.last(c, ignorenulls=True).over(along) for c in ("__part", "__before")}).where("tree IS NOT NULL")
    picks = held.groupBy(key, "__part", "__n").agg(F.collect_list(F.struct((F.col("__place") - F.col("__before")).alias("at"), "tree")).alias("__picks"))
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(key, "__part").orderBy("__o", row)) - 1)
    met = placed.join(picks, [key, "__part"]).withColumn("__pick", F.explode(F.filter("__picks", lambda p: p["at"] == F.col("__at"))))
    return met.select(key, F.col("__pick.tree").alias("tree"), "__n", row, *features)


def grow(x: np.ndarray, name: str, depth: int) -> list[tuple[int, int, float, float]]:
    """(node, feature, cut, path) of a tree over the rows of ``x``; a leaf has feature -1 and the path of its rows, an inner node path 0."""
    out, open_nodes = [], [(1, 0, x)]
    while open_nodes:
        node, level, rows = open_nodes.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        wide = np.flatnonzero(high > low)
        if level >= depth or len(rows) <= 1 or not len(wide):
            out.append((node, -1, 0.0, level + expected_path(len(rows))))
            continue
        digest = hashlib.sha256(f"{name}:{node}".encode()).hexdigest()
        feature = int(wide[int(digest[:8], 16) % len(wide)])
        cut = float(low[feature] + int(digest[8:16], 16) / 4294967296.0 * (high[feature] - low[feature]))
        out.append((node, feature, cut, 0.0))
        below = rows[:, feature] < cut
        open_nodes += [(2 * node, level + 1, rows[below]), (2 * node + 1, level + 1, rows[~below])]
    return out


def _draw_from_pool(whole: DataFrame, key: str, row: str, features: list[str], spec: ForestSpec) -> DataFrame:
    """The same from the first ``spec.pool`` rows of each key by hash."""
    pool = _first(whole.select(key, row, *features), [key], _draw(F.col(key), F.col(row)), spec.pool)
    sizes = pool.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= spec.least)
    pool = pool.join(sizes, key).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(spec.trees - 1))))
    order = _draw(F.lit(spec.seed), F.col(key), F.col("tree"), F.col(row))
    return pool.withColumn("__r", F.row_number().over(Window.partitionBy(key, "tree").orderBy(order))).where(F.col("__r") <= spec.sample)


def fit_forest(df: DataFrame, key: str, row: str, features: list[str], spec: ForestSpec = ForestSpec()) -> DataFrame:
    """(key, sampled, tree, node, feature, cut, path): the forest of each value of ``key``.

    ``row`` names a row within its key. Rows with a null or not finite feature take no part. A tree is of ``spec.sample`` rows at most, so a group that
    grows a tree holds no more whatever the data; they are drawn from all rows of the key, or with ``spec.pool`` from so many of them.
    """
    ship(df.sparkSession)
    whole = df
    for f in features:
        whole = whole.where(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf")))
    drawn = draw_from_all(whole, key, row, features, spec) if spec.pool is None else _draw_from_pool(whole, key, row, features, spec)
    kind = dict(df.dtypes)[key]

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        k, t = rows[key].iloc[0], int(rows["tree"].iloc[0])
        nodes = grow(rows[features].to_numpy(float), f"{spec.seed}:{k}:{t}", spec.depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "path"])
        out.insert(0, "tree", t)
        out.insert(0, "sampled", min(spec.sample, int(rows["__n"].iloc[0])))
        out.insert(0, key, k)
        return out

    return drawn.select(key, "tree", "__n", *features).groupBy(key, "tree").applyInPandas(tree, f"{key} {kind}, sampled int, {NODES}")


def path_lengths(x: np.ndarray, nodes: pd.DataFrame, depth: int) -> np.ndarray:
    """Mean path of each row of ``x`` over the trees of ``nodes``: all trees are walked level by level."""
    trees, at = np.unique(nodes["tree"].to_numpy(), return_inverse=True)
    shape = (len(trees), 2 << depth)
    feature, cut, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
    ids = nodes["node"].to_numpy()
    feature[at, ids], cut[at, ids], path[at, ids] = nodes["feature"], nodes["cut"], nodes["path"]
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for t in range(len(trees)):
        here = np.ones(len(x), np.int64)
        for _ in range(depth):
            f = feature[t, here]
            inner = f >= 0
            here = np.where(inner, 2 * here + (x[rows, np.maximum(f, 0)] >= cut[t, here]), here)
        total += path[t, here]
    return total / len(trees)


def anomaly_scores(df: DataFrame, forest: DataFrame, key: str, row: str, features: list[str], spec: ForestSpec = ForestSpec(), block: int = 50_000) -> DataFrame:
    """(key, row, anomaly): 2 ** (-mean path / expected path of the sample), from 0 to 1, higher for rows that are cut off sooner.

    Rows of keys without a forest and rows with a missing feature give none. Rows meet their key's forest in blocks of about ``block`` rows, so a
    key of any size is spread over tasks; a task holds a block and one forest.
    """
    ship(df.sparkSession)
    whole = df
    for f in features:
        whole = whole.where(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf")))
    sizes = whole.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    rows = whole.select(key, row, *features).join(F.broadcast(sizes), key).withColumn("__b", F.pmod(F.xxhash64(row), F.col("__blocks")).cast("int"))
    there = sizes.toDF("__k", "__blocks_there")
    nodes = forest.join(F.broadcast(there), F.col(key) == F.col("__k")).withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__blocks_there") - 1)))
    nodes = nodes.select("__k", "__at", "sampled", "tree", "node", "feature", "cut", "path")
    kinds = dict(df.dtypes)

    def score(some: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if some.empty or trees.empty:
            return pd.DataFrame({key: [], row: [], "anomaly": []}).astype({key: some[key].dtype, row: some[row].dtype, "anomaly": float})
        mean = path_lengths(some[features].to_numpy(float), trees, spec.depth)
        usual = expected_path(int(trees["sampled"].iloc[0]))
        return pd.DataFrame({key: some[key], row: some[row], "anomaly": np.exp2(-mean / usual)})

    met = rows.groupBy(key, "__b").cogroup(nodes.groupBy("__k", "__at"))
    return met.applyInPandas(score, f"{key} {kinds[key]}, {row} {kinds[row]}, anomaly double")


def forest_sql(rows: str, fitted: str, key: str, row: str, features: list[str], spec: ForestSpec = ForestSpec()) -> str:
    """The same forests and scores in SQL, as common table expressions that end in ``anomalies`` (key, row, anomaly): rows of ``rows`` are scored, those
    with ``fitted`` are drawn from. Each level of all trees is one step in which drawn rows set the cuts and all rows follow them."""
    h = lambda a, b: f"CAST('0x' || h[{a}:{b}] AS BIGINT)"
    hashed = lambda parts: f"CAST('0x' || sha256(concat({parts}))[1:15] AS BIGINT)"
    c = lambda n: f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0::DOUBLE) + {EULER}) - 2.0 * ({n} - 1.0::DOUBLE) / {n} END"
    xs = ", ".join(features)
    finite = " AND ".join(f"isfinite({f})" for f in features)
    if spec.pool is None:
        draws = [
            f"""placed AS MATERIALIZED (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY {hashed("k, ':', w")}, w) - 1 AS place, count(*) OVER (PARTITION BY k) AS np FROM fr WHERE fit)""",
            f"""keyed AS MATERIALIZED (SELECT k, any_value(np) AS np, least({spec.sample}, any_value(np)) AS psi FROM placed WHERE np >= {spec.least} GROUP BY k)""",
            f"""stretches AS (SELECT k, tree, np * j // psi AS lo, np * (j + 1) // psi AS hi, {hashed(f"'{spec.seed}:', k, ':', tree, ':row:', j")} AS u FROM keyed, (SELECT unnest(range({spec.trees})) AS tree), (SELECT unnest(range({spec.sample})) AS j) WHERE j < psi)""",
            """drawn AS MATERIALIZED (SELECT p.k, p.w, s.tree FROM placed p JOIN (SELECT k, tree, lo + u % (hi - lo) AS place FROM stretches) s ON s.k = p.k AND s.place = p.place)""",
        ]
    else:
        draws = [
            f"""pool AS (SELECT *, count(*) OVER (PARTITION BY k) AS np FROM (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY sha256(concat(k, ':', w))) AS rn FROM fr WHERE fit) WHERE rn <= {spec.pool})""",
            f"""drawn AS MATERIALIZED (SELECT k, w, tree FROM (SELECT k, w, tree, row_number() OVER (PARTITION BY k, tree ORDER BY sha256(concat('{spec.seed}:', k, ':', tree, ':', w))) AS rn FROM pool, (SELECT unnest(range({spec.trees})) AS tree) WHERE np >= {spec.least}) WHERE rn <= {spec.sample})""",
            f"""keyed AS (SELECT k, least({spec.sample}, max(np)) AS psi FROM pool WHERE np >= {spec.least} GROUP BY k)""",
        ]
    out = [
        f"""fr AS MATERIALIZED (SELECT {key} AS k, {row} AS w, {xs}, {fitted} AS fit FROM {rows} WHERE {finite})""",
        *draws,
        f"""l0 AS MATERIALIZED (SELECT fr.k, fr.w, t.tree, 1 AS node, {xs}, d.w IS NOT NULL AS d FROM fr JOIN keyed USING (k) CROSS JOIN (SELECT unnest(range({spec.trees})) AS tree) t LEFT JOIN drawn d ON d.k = fr.k AND d.w = fr.w AND d.tree = t.tree)""",
    ]
    ends = []
    for level in range(spec.depth):
        wide = "list_filter([" + ", ".join(f"CASE WHEN hi{j} > lo{j} THEN {j} END" for j in range(len(features))) + "], lambda e: e IS NOT NULL)"
        bounds = ", ".join(f"min({f}) FILTER (d) AS lo{j}, max({f}) FILTER (d) AS hi{j}" for j, f in enumerate(features))
        pick = lambda name: "CASE f " + " ".join(f"WHEN {j} THEN {name(j)}" for j in range(len(features))) + " END"
        out += [
            f"""s{level} AS (SELECT k, tree, node, n, {wide} AS wide, sha256(concat('{spec.seed}:', k, ':', tree, ':', node)) AS h, {", ".join(f"lo{j}, hi{j}" for j in range(len(features)))} FROM (SELECT k, tree, node, count(*) FILTER (d) AS n, {bounds} FROM l{level} GROUP BY k, tree, node))""",
            f"""n{level} AS MATERIALIZED (SELECT k, tree, node, n, f, {pick(lambda j: f"lo{j} + u * (hi{j} - lo{j})")} AS cut FROM (SELECT *, CASE WHEN n > 1 AND len(wide) > 0 THEN wide[1 + {h(1, 8)} % len(wide)] END AS f, {h(9, 16)} / 4294967296.0::DOUBLE AS u FROM s{level}))""",
            f"""e{level} AS (SELECT l.k, l.w, {level} + {c("n")} AS path FROM l{level} l JOIN n{level} USING (k, tree, node) WHERE f IS NULL)""",
            f"""l{level + 1} AS MATERIALIZED (SELECT l.k, l.w, tree, 2 * node + CASE WHEN {pick(lambda j: "l." + features[j])} >= cut THEN 1 ELSE 0 END AS node, {", ".join("l." + f for f in features)}, l.d FROM l{level} l JOIN n{level} USING (k, tree, node) WHERE f IS NOT NULL)""",
        ]
        ends.append(f"SELECT * FROM e{level}")
    last = spec.depth
    out += [
        f"""z{last} AS (SELECT k, tree, node, count(*) FILTER (d) AS n FROM l{last} GROUP BY k, tree, node)""",
        f"""paths AS ({" UNION ALL ".join(ends)} UNION ALL SELECT k, w, {last} + {c("n")} FROM l{last} JOIN z{last} USING (k, tree, node))""",
        f"""anomalies AS (SELECT k, w, pow(2.0::DOUBLE, -(sum(path) / {spec.trees}) / ({c("any_value(psi)")})) AS anomaly FROM paths JOIN keyed USING (k) GROUP BY k, w)""",
    ]
    return ",\n".join(out)
