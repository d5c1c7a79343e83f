"""The line as a small graph: edges, reachability, buffer distances and how a disturbance spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Decay of starvation and of blocking with buffer distance. Fixed values.
LAMBDA_STARVE, LAMBDA_BLOCK, UNREACHABLE = 16.0, 9.0, 1e6


def chain_edges(stations: DataFrame) -> DataFrame:
    """(src, dst, buffer_capacity) of a line without explicit edges: each station to the next by its outgoing buffer."""
    w = Window.orderBy("station")
    return stations.select(F.col("station").alias("src"), F.lead("station").over(w).alias("dst"), F.col("out_buffer").alias("buffer_capacity")).where("dst IS NOT NULL")


def reachable(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(src, dst): every pair with a path, of any length. Each round doubles the length of the paths that are known, until no pair is new. Dimension data only."""
    known, r = -1, edges.select("src", "dst").distinct()
    while True:
        rows = r.collect()
        r = spark.createDataFrame(rows, r.schema)  # at most stations x stations rows
        if len(rows) == known:
            return r
        known = len(rows)
        step = r.toDF("src", "mid").join(F.broadcast(r.toDF("mid", "dst")), "mid").select("src", "dst")
        r = r.union(step).distinct()


def serial_distance(stations: DataFrame) -> DataFrame:
    """(k, i, dist): buffer places between two stations of a chain, from prefix sums."""
    before = F.coalesce(F.sum("out_buffer").over(Window.orderBy("station").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = stations.select("station", before.alias("p"))
    return p.toDF("k", "pk").crossJoin(F.broadcast(p.toDF("i", "pi"))).select("k", "i", F.abs(F.col("pi") - F.col("pk")).cast("double").alias("dist"))


def graph_distance(spark: SparkSession, stations: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, i, dist): the least sum of buffers along edges in either direction; a million where there is no way.

    Min-plus squaring over the dense pair table: the longest way has fewer edges than there are stations, so
    log2(stations) rounds settle it. Dimension data only.
    """
    nodes = stations.select(F.col("station").alias("k"))
    both = edges.select(F.col("src").alias("k"), F.col("dst").alias("i"), "buffer_capacity").union(edges.select("dst", "src", "buffer_capacity"))
    one = both.groupBy("k", "i").agg(F.min("buffer_capacity").cast("double").alias("d")).union(nodes.select("k", F.col("k").alias("i"), F.lit(0.0).alias("d")))
    one = one.groupBy("k", "i").agg(F.min("d").alias("d"))
    n = stations.count()
    rounds, d = max(1, (n - 1).bit_length()), one
    for _ in range(rounds):
        step = d.toDF("k", "m", "d1").join(F.broadcast(d.toDF("m", "i", "d2")), "m").groupBy("k", "i").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
        d = spark.createDataFrame(step.collect(), step.schema)  # at most stations x stations rows
    grid = nodes.crossJoin(nodes.select(F.col("k").alias("i")))
    return grid.join(d, ["k", "i"], "left").select("k", "i", F.coalesce("d", F.lit(UNREACHABLE)).alias("dist"))


def propagation(dist: DataFrame, reach: DataFrame) -> DataFrame:
    """(k, i, dist, b, s): how much a slow station k blocks an upstream observer i and starves a downstream one."""
    up = reach.select(F.col("src").alias("i"), F.col("dst").alias("k"), F.lit(1).alias("up"))
    down = reach.select(F.col("src").alias("k"), F.col("dst").alias("i"), F.lit(1).alias("down"))
    d = dist.join(up, ["k", "i"], "left").join(down, ["k", "i"], "left")
    b = F.when(F.col("up") == 1, F.exp(-F.col("dist") / LAMBDA_BLOCK)).otherwise(0.0)
    s = F.when(F.col("down") == 1, F.exp(-F.col("dist") / LAMBDA_STARVE)).otherwise(0.0)
    return d.select("k", "i", "dist", b.alias("b"), s.alias("s"))


def zone_bounds(stations: DataFrame) -> DataFrame:
    """(zone, first, last, rich, basic, manual)."""
    tiers = [F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("RICH", "BASIC", "MANUAL")]
    return stations.groupBy("zone").agg(F.min("station").alias("first"), F.max("station").alias("last"), *tiers)


def topological_depth(spark: SparkSession, stations: DataFrame, edges: DataFrame) -> DataFrame:
    """(station, depth): the longest path that ends at a station; a cycle would run past the number of stations and is an error."""
    n = stations.count()
    edges.createOrReplaceTempView("__tw_edges")
    stations.createOrReplaceTempView("__tw_stations")
    paths = spark.sql(f"WITH RECURSIVE r(station, depth) AS (SELECT station, 0 FROM __tw_stations UNION ALL SELECT e.dst, depth + 1 FROM r JOIN __tw_edges e ON r.station = e.src WHERE depth <= {n}) SELECT station, max(depth) AS depth FROM r GROUP BY station")
    deep = paths.agg(F.max("depth")).first()[0]
    if deep is not None and deep >= n:
        raise ValueError("the line has a cycle")
    return paths


def nearest_observed(stations: DataFrame, k: int) -> DataFrame:
    """(station, side, observed, rank): the k nearest stations with sensors on each side."""
    seen = stations.where("tier <> 'MANUAL'").select(F.col("station").alias("observed"))
    pairs = stations.select("station").crossJoin(F.broadcast(seen)).where("station <> observed")
    pairs = pairs.withColumn("side", F.when(F.col("observed") < F.col("station"), "up").otherwise("down"))
    rank = F.row_number().over(Window.partitionBy("station", "side").orderBy(F.abs(F.col("observed") - F.col("station"))))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("station", "side", "observed", "rank")
