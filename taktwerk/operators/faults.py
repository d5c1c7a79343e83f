"""Faults of sensors, laid over telemetry by a list, and the windows that give a silent fault away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of faults and tags of rows. Fixed values.
DROPOUT, INTERMITTENT, NOISY, STALE, OBSERVED = "DROPOUT", "INTERMITTENT", "NOISY", "STALE", "OBSERVED"
KINDS = (DROPOUT, INTERMITTENT, NOISY, STALE)
#: Share of the mean that stands for the spread of a channel that does not vary, and the least spread. Fixed values.
FLAT_SHARE, LEAST_SPREAD = 0.2, 1e-6
SCHEMA = "fault_id long, station int, kind string, t_from double, t_to double, noise_frac double, burst_on_s double, burst_off_s double"


def normal_noise(*parts: Column) -> Column:
    """A standard normal number that depends on the parts alone: two 32-bit groups of their SHA-256 through Box and Muller. The same on every rerun and in every partitioning."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    unit = lambda a: (F.conv(F.substring(h, a, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2.0 * F.ln(unit(1))) * F.cos(2.0 * F.pi() * unit(9))


def _in_turn(faults: DataFrame) -> list[int]:
    """How many noisy or stale faults the station with the most has: 0 to n - 1."""
    most = faults.where(F.col("kind").isin(NOISY, STALE)).groupBy("station").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return list(range(most or 0))


def _changed(tel: DataFrame, one: DataFrame, channels: list[str], t: str, order: list[str], seed: int, digits: int) -> DataFrame:
    """``tel`` after a round of faults, one a station at most: ``one`` (station, fault_id, kind, t_from, t_to, noise_frac)."""
    f = F.broadcast(one.select("station", *[F.col(c).alias(f"__{c}") for c in ("fault_id", "kind", "t_from", "t_to", "noise_frac")]))
    d = tel.join(f, "station")
    hit = (F.col(t) >= F.col("__t_from")) & (F.col(t) < F.col("__t_to"))
    at = F.struct(*[F.col(c) for c in (t, *order)])
    stats = []
    for c in channels:
        v = F.when(hit, F.col(c))
        stats += [F.stddev_pop(v).alias(f"__sd_{c}"), F.avg(F.abs(v)).alias(f"__mean_{c}"), F.max_by(F.struct(c), F.when(F.col(t) < F.col("__t_from"), at)).alias(f"__last_{c}"), F.min_by(F.struct(c), F.when(hit, at)).alias(f"__first_{c}")]
    per = d.groupBy("station").agg(*stats)  # a row a station
    d = tel.join(f, "station", "left").join(F.broadcast(per), "station", "left")
    hit = F.coalesce(hit, F.lit(False))
    new = {}
    for c in channels:
        sd = F.round(f"__sd_{c}", digits)
        spread = F.greatest(F.when(sd > 0, sd).otherwise(F.round(F.col(f"__mean_{c}") * FLAT_SHARE + LEAST_SPREAD, digits)), F.lit(LEAST_SPREAD))
        z = normal_noise(F.lit(seed), F.col("__fault_id"), F.col("station"), *[F.col(o) for o in order], F.lit(c))
        noisy = F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.round(F.col(c) + F.col("__noise_frac") * spread * z, digits)))
        held = F.when(F.col(f"__last_{c}").isNotNull(), F.col(f"__last_{c}")[c]).otherwise(F.col(f"__first_{c}")[c])
        new[c] = F.when(hit & (F.col("__kind") == NOISY), noisy).when(hit & (F.col("__kind") == STALE), held).otherwise(F.col(c))
    new["data_quality"] = F.when(hit, F.col("__kind")).otherwise(F.col("data_quality"))
    return d.withColumns(new).select(*tel.columns)


def apply_faults(telemetry: DataFrame, faults: DataFrame, channels: list[str], t: str = "t_depart_s", order: tuple[str, ...] = ("vehicle_id",), seed: int = 0, bucket_s: float = 3600.0, digits: int = 9) -> DataFrame:
    """``telemetry`` (station, t, order, channels, ...) under a list of faults, with ``data_quality``: OBSERVED, or the kind of the last fault that changed the row.

    ``faults`` as in SCHEMA; a fault covers [t_from, t_to). Faults of a station act by fault_id. NOISY adds normal noise with ``noise_frac`` of the channel's spread
    within the fault (a flat channel: 0.2 of its mean) and stops at 0. STALE repeats the station's last row before the fault, or the fault's first. DROPOUT rows are gone; INTERMITTENT rows are gone but for the
    first ``burst_on_s`` of each ``burst_on_s + burst_off_s`` (at least a second). Lost rows still count for what the other kinds measure. Rows without a time
    or a station are kept as they are; another kind is an error.

    The changing kinds act in rounds, the n-th fault of every station in round n: a round is one sum by station and broadcasts of a row a station.
    Losses, of any number, meet the rows by station and time bucket in one anti-join.
    """
    other = [x[0] for x in faults.where(~F.col("kind").isin(*KINDS) | F.col("kind").isNull()).select("kind").distinct().limit(5).collect()]
    if other:
        raise ValueError(f"unknown kinds of faults: {other}")
    d = telemetry.withColumn("data_quality", F.lit(OBSERVED))
    changing = faults.where(F.col("kind").isin(NOISY, STALE))
    turns = changing.alias("a").join(changing.select("station", F.col("fault_id").alias("before")).alias("b"), "station").groupBy("fault_id", "station", "kind", "t_from", "t_to", "noise_frac").agg(F.count_if(F.col("before") < F.col("fault_id")).alias("turn"))
    d = reduce(lambda x, n: _changed(x, turns.where(F.col("turn") == n), channels, t, list(order), seed, digits), _in_turn(faults), d)
    lost = faults.where(F.col("kind").isin(DROPOUT, INTERMITTENT) & (F.col("t_from") < F.col("t_to")))
    lost = lost.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t_from") / bucket_s), F.floor(F.col("t_to") / bucket_s))))
    lost = lost.select(*[F.col(c).alias(f"__{c}") for c in ("station", "bucket", "kind", "t_from", "t_to", "burst_on_s", "burst_off_s")])
    phase = F.pmod(F.col(t) - F.col("__t_from"), F.greatest(F.col("__burst_on_s") + F.col("__burst_off_s"), F.lit(1.0)))
    within = (F.col(t) >= F.col("__t_from")) & (F.col(t) < F.col("__t_to")) & ((F.col("__kind") == DROPOUT) | (phase >= F.col("__burst_on_s")))
    return d.join(lost, (F.col("station") == F.col("__station")) & (F.floor(F.col(t) / bucket_s) == F.col("__bucket")) & within, "left_anti")


def stale_suspect(windows: DataFrame, channel: str = "proc_time_s", least_std: float = 0.05, least_rows: int = 6) -> DataFrame:
    """``windows`` with ``stale_suspect``: ``least_rows`` or more values that hardly differ (no deviation counts as 0). Without a count a window is not suspected."""
    return windows.withColumn("stale_suspect", F.coalesce((F.coalesce(f"{channel}_std", F.lit(0.0)) < least_std) & (F.col(f"{channel}_count") >= least_rows), F.lit(False)))


def mask_suspect(windows: DataFrame) -> DataFrame:
    """The windows that are not suspected; all of them where nothing was flagged."""
    return windows.where(~F.col("stale_suspect")) if "stale_suspect" in windows.columns else windows
