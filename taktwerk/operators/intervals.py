"""Intervals from change logs, their overlap with occupancy windows, as-of lookups and inequality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State labels after normalising, by kind. Fixed values.
STATE_KINDS = {
    "blocked_s": ("blocked", "blocking", "blk", "outfeed_full"),
    "starved_s": ("starved", "starving", "strv", "infeed_empty", "waiting_for_part"),
}
#: Labels of a station at work: known, but no waiting. Fixed values.
RUNNING = ("running", "run", "execute", "producing", "active", "auto")
#: Labels of a station that is down: known, and no waiting either. Fixed values.
FAULT = ("fault", "faulted", "stopped", "aborted", "held", "down", "estop")


def state_key(label: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), " -", "__")


def state_kind(label: Column) -> Column:
    """blocked_s, starved_s or other."""
    key, out = state_key(label), F.lit("other")
    for kind, names in STATE_KINDS.items():
        out = F.when(key.isin(*names), kind).otherwise(out)
    return out


def close_intervals(states: DataFrame) -> DataFrame:
    """(station, state_kind, t0, t1): each state lasts to the station's next change, the last to the end of the whole log."""
    end = states.agg(F.max("t_s").alias("end"))
    nxt = F.lead("t_s").over(Window.partitionBy("station").orderBy("t_s", "seq"))
    closed = states.withColumn("next", nxt).crossJoin(F.broadcast(end))
    t1 = F.greatest(F.coalesce("next", "end"), F.col("t_s"))
    return closed.select("station", state_kind(F.col("state")).alias("state_kind"), F.col("t_s").alias("t0"), t1.alias("t1"))


def occupancy(scans: DataFrame) -> DataFrame:
    """(station, vehicle_id, t_start_s, t_depart_s): a unit's window starts at the previous departure; a station's first has no length."""
    before = F.lag("t_s").over(Window.partitionBy("station").orderBy("t_s", "vehicle_id"))
    return scans.select("station", "vehicle_id", F.coalesce(before, "t_s").alias("t_start_s"), F.col("t_s").alias("t_depart_s"))


def interval_overlap(windows: DataFrame, intervals: DataFrame, bucket_s: float) -> DataFrame:
    """(station, vehicle_id, blocked_s, starved_s): each window's share of the station's blocked and starved intervals.

    Both sides are cut at multiples of ``bucket_s`` and meet on (station, bucket): an equi-join whose fan-out is bounded by the bucket,
    where a plain inequality join would pair all of a station. Parts add up, so nothing is counted twice. Choose the
    bucket near the usual length of an interval.
    """

    def cut(df: DataFrame, lo: str, hi: str) -> DataFrame:
        b = F.explode(F.sequence(F.floor(F.col(lo) / bucket_s), F.floor(F.col(hi) / bucket_s)))
        df = df.withColumn("bucket", b)
        return df.withColumns({lo: F.greatest(F.col(lo), F.col("bucket") * bucket_s), hi: F.least(F.col(hi), (F.col("bucket") + 1) * bucket_s)})

    kinds = intervals.where(F.col("state_kind").isin("blocked_s", "starved_s") & (F.col("t1") > F.col("t0")))
    w = cut(windows.where("t_depart_s > t_start_s"), "t_start_s", "t_depart_s")
    i = cut(kinds, "t0", "t1")
    shared = F.least("t1", "t_depart_s") - F.greatest("t0", "t_start_s")
    parts = w.join(i, ["station", "bucket"]).where("t0 < t_depart_s AND t1 > t_start_s").select("station", "vehicle_id", "state_kind", shared.alias("s"))
    sums = parts.groupBy("station", "vehicle_id").agg(*[F.sum(F.when(F.col("state_kind") == k, F.col("s")).otherwise(0.0)).alias(k) for k in ("blocked_s", "starved_s")])
    return windows.select("station", "vehicle_id").join(sums, ["station", "vehicle_id"], "left").fillna(0.0, ["blocked_s", "starved_s"])


def as_of(left: DataFrame, right: DataFrame, *, keys: list[str], t: str, value: str, forward: bool, bucket_s: float, clamp: bool = True) -> DataFrame:
    """``left`` with ``value`` of the right row at or after (``forward``) or at or before its ``t``; past the end, of the last (first) row if ``clamp``.

    A union of both sides and a running last value, in time buckets: each bucket starts with what the nearest earlier one carried over,
    so the windows are as long as a bucket's rows and not a whole series.
    """
    sign = -1.0 if forward else 1.0
    cols = left.columns
    time = F.col(t) * sign
    both = left.select(*cols, time.alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v")).unionByName(
        right.select(*keys, time.alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v")), allowMissingColumns=True
    )
    both = both.withColumn("__b", F.floor(F.col("__t") / bucket_s))
    per = both.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"), F.min_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__first"))
    w = Window.partitionBy(*keys).orderBy("__b")
    per = per.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__pb"), F.last("__end", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__first", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__least"))
    cond = F.col("__b") == F.col("__pb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = F.last("__v", True).over(Window.partitionBy(*keys, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("__in", within).where("__side = 1").join(per, cond)
    found = F.coalesce("__in", "__before", *(["__least"] if clamp else []))
    return out.select(*cols, found.alias(value))


def inequality_count(left: DataFrame, right: DataFrame, key: str, t: str) -> DataFrame:
    """``left`` with ``n_before``: how many right rows of the key have a strictly smaller time. One union and a running count."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.select(key, t, F.lit(1).alias("__side")), allowMissingColumns=True)
    # Left rows come first at equal times, so equal times do not count.
    n = F.sum("__side").over(Window.partitionBy(key).orderBy(t, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("n_before", n.cast("long")).where("__side = 0").drop("__side")


def state_coverage(states: DataFrame, scans: DataFrame) -> DataFrame:
    """(station, scan_span_s, state_span_s, coverage): the share of the scans' time that the log covers; null for no span."""
    span = lambda df, name: df.groupBy("station").agg((F.max("t_s") - F.min("t_s")).alias(name))
    out = span(scans, "scan_span_s").join(span(states, "state_span_s"), "station", "left")
    ratio = F.least(F.lit(1.0), F.col("state_span_s") / F.col("scan_span_s"))
    return out.withColumn("coverage", F.when(F.col("scan_span_s") > 0, F.coalesce(ratio, F.lit(0.0))))


def unknown_labels(states: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct labels of the log whose key is not among ``known`` (key)."""
    return states.select("state", state_key(F.col("state")).alias("key")).distinct().join(F.broadcast(known), "key", "left_anti").select("state")
