"""Order-dependent logic as windows: runs, smoothing, slopes, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_length(df: DataFrame, keys: list[str], order: list[str], flag: Column, joins: Column | None = None) -> DataFrame:
    """``df`` with ``run``: how many rows in a row, up to this one, have ``flag`` and (``joins``) continue the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    go_on = F.lag(flag.cast("int"), 1, 0).over(w) == 1
    if joins is not None:
        go_on = go_on & F.coalesce(joins, F.lit(False))
    d = df.withColumn("__f", F.coalesce(flag, F.lit(False)).cast("int"))
    d = d.withColumn("__new", F.when((F.col("__f") == 1) & go_on, 0).otherwise(1))
    d = d.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(*keys, "__island").orderBy(*order)
    return d.withColumn("run", F.when(F.col("__f") == 1, F.row_number().over(inside)).otherwise(0)).drop("__f", "__new", "__island")


def gaps(df: DataFrame, keys: list[str], t: str, tie: str, bucket_s: float) -> DataFrame:
    """(keys..., gap): time since the row before, by key. Rows are lagged within buckets of time; a bucket's first row takes the last time of the buckets before it,
    so no task sorts more than a bucket of a key, beside one row a bucket."""
    d = df.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("__t"), F.col(tie).alias("__tie"), F.floor(F.col(t) / bucket_s).alias("__b"))
    ends = d.groupBy(*keys, "__b").agg(F.max("__t").alias("__end"))
    edges = ends.select(*keys, "__b", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__b")).alias("__edge"))
    inside = F.lag("__t").over(Window.partitionBy(*keys, "__b").orderBy("__t", "__tie"))
    gap = F.col("__t") - F.coalesce("__p", "__edge")
    return d.withColumn("__p", inside).join(edges, [*keys, "__b"]).select(*keys, gap.alias("gap")).where("gap IS NOT NULL")


def first_sustained(df: DataFrame, run: int, block: int = 4096) -> DataFrame:
    """(board_moment_s): the earliest ``t_depart_s`` at which ``below`` has held for ``run`` positions in a row, of (pos, t_depart_s, below) with gapless positions; null if never.

    Blocks of positions overlap by the run's length, so each is judged alone."""
    k = F.floor(F.col("pos") / block)
    shared = F.col("pos") % block >= block - (run - 1)
    d = df.select("pos", "t_depart_s", "below", F.explode(F.when(shared, F.array(k, k + 1)).otherwise(F.array(k))).alias("k"))
    held = F.sum(F.col("below").cast("int")).over(Window.partitionBy("k").orderBy("pos").rowsBetween(-(run - 1), 0))
    return d.withColumn("held", held).where(F.col("held") == run).agg(F.min("t_depart_s").alias("board_moment_s"))


def ewma(df: DataFrame, keys: list[str], order: str, value: str, name: str, alpha: float = 0.55, memory: int = 64) -> DataFrame:
    """Exponential smoothing that starts from the first value; nulls count as 0. (1 - alpha) ** memory is below a double's precision,
    so a fold over that many rows is the whole recursion, and no window grows with the series."""
    w = Window.partitionBy(*keys).orderBy(order)
    held = F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(w.rowsBetween(-(memory - 1), 0))
    fold = F.aggregate(F.slice("__h", 2, memory), F.col("__h")[0], lambda acc, x: F.lit(alpha) * x + F.lit(1 - alpha) * acc)
    return df.withColumn("__h", held).withColumn(name, fold).drop("__h")


def trailing_slope(df: DataFrame, keys: list[str], order: str, value: str, name: str, rows: int, least: int) -> DataFrame:
    """Least-squares slope of the last ``rows`` values against their position; 0 below ``least`` of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-(rows - 1), 0)
    d = df.withColumn("__i", F.row_number().over(w).cast("double"))
    slope = F.when(F.count(value).over(frame) >= least, F.regr_slope(value, "__i").over(frame)).otherwise(0.0)
    return d.withColumn(name, F.coalesce(slope, F.lit(0.0))).drop("__i")


def predict_states(df: DataFrame, keys: list[str], order: str, *, detect: float, watch: float, rising: float) -> DataFrame:
    """``df`` (confident, llr, cycle_s, takt_s, slope) with ``state``: ACTIVE, PREDICTED, WATCH, DEGRADING, RECOVERING or NORMAL.

    RECOVERING depends on the state before. Rows that no other rule takes form islands; an island recovers from its first row if the row before it was
    elevated and the slope falls faster than ``rising``, and goes on while the slope does not rise.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = F.col("confident") & (F.col("llr") >= detect)
    base = F.when(ahead & (F.col("cycle_s") > F.col("takt_s")), "ACTIVE").when(ahead, "PREDICTED").when(F.col("llr") >= watch, "WATCH").when(F.col("slope") > rising, "DEGRADING")
    d = df.withColumn("__base", base)
    before = F.lag("__base").over(w)
    d = d.withColumn("__before", before).withColumn("__row", F.row_number().over(w))
    starts = F.col("__base").isNull() & ((F.col("__row") == 1) | F.col("__before").isNotNull())
    d = d.withColumn("__island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy(*keys, "__island").orderBy(order)
    rest = d.where("__base IS NULL")
    first = F.first(F.coalesce(F.col("__before").isin("WATCH", "PREDICTED", "ACTIVE"), F.lit(False)) & (F.col("slope") < -rising)).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = rest.withColumn("__n", F.row_number().over(inside)).withColumn("__first", first)
    broken = F.sum(F.when((F.col("__n") > 1) & (F.col("slope") > 0), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = rest.withColumn("state", F.when(F.col("__first") & (broken == 0), "RECOVERING").otherwise("NORMAL"))
    named = d.where("__base IS NOT NULL").withColumn("state", F.col("__base"))
    drop = ["__base", "__before", "__row", "__island"]
    return rest.drop(*drop, "__n", "__first").unionByName(named.drop(*drop))


def hash_chain_breaks(ledger: DataFrame, body: Column, genesis: str) -> DataFrame:
    """(entry_id, linked, intact) of a chained ledger (entry_id, prev_hash, entry_hash): does a row name the hash before it, and is its own hash that of its content."""
    w = Window.orderBy("entry_id") if "chain" not in ledger.columns else Window.partitionBy("chain").orderBy("entry_id")
    before = F.coalesce(F.lag("entry_hash").over(w), F.lit(genesis))
    keep = [c for c in ("chain", "entry_id") if c in ledger.columns]
    return ledger.select(*keep, (before == F.col("prev_hash")).alias("linked"), (F.sha2(F.concat(F.col("prev_hash"), body), 256) == F.col("entry_hash")).alias("intact"))
