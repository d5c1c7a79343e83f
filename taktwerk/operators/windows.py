"""Sliding windows of units: window w covers the units [warmup + stride * w, ... + width)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Panes that a task sums together.
PANES = 64


@dataclass(frozen=True)
class WindowSpec:
    width: int = 20
    stride: int = 5
    warmup: int = 20

    def count(self, n_vehicles: int) -> int:
        """Only full windows exist."""
        return max(0, (n_vehicles - self.warmup - self.width) // self.stride + 1)

    @staticmethod
    def for_line(out_buffers: list[int], **kw: int) -> WindowSpec:
        """Warm-up is the stations and up to 100 places of each buffer."""
        return WindowSpec(warmup=len(out_buffers) + sum(min(b, 100) for b in out_buffers), **kw)


def n_vehicles(df: DataFrame) -> DataFrame:
    return df.agg((F.max("vehicle_id") + 1).alias("n_vehicles"))


def in_windows(df: DataFrame, spec: WindowSpec, total: DataFrame) -> DataFrame:
    """Each row once for each full window that holds its vehicle, with ``window``."""
    v = F.col("vehicle_id") - spec.warmup
    lo = F.greatest(F.lit(0), F.ceil((v - spec.width + 1) / spec.stride))
    last = F.floor((F.col("n_vehicles") - spec.warmup - spec.width) / spec.stride)
    df = df.crossJoin(F.broadcast(total)).withColumns({"__lo": lo.cast("long"), "__hi": F.least(F.floor(v / spec.stride), last).cast("long")})
    return df.where("__lo <= __hi").withColumn("window", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi", "n_vehicles")


def window_counts(df: DataFrame, spec: WindowSpec, value: str, total: DataFrame) -> DataFrame:
    """(window, value, n): rows of each value in each full window, counted by pane first; a pane, not a row, is copied for the windows that hold it. Width must be a multiple of stride; else rows are copied."""
    if spec.width % spec.stride:
        return in_windows(df.select("vehicle_id", value), spec, total).groupBy("window", value).agg(F.count(F.lit(1)).alias("n"))
    pane = F.floor((F.col("vehicle_id") - spec.warmup) / spec.stride)
    near = df.where(F.col("vehicle_id") >= spec.warmup).select(value, pane.alias("pane"), F.floor(pane / PANES).alias("__near")).repartition("__near")
    panes = near.groupBy("__near", "pane", value).agg(F.count(F.lit(1)).alias("n"))
    return _covering(panes, spec, total).groupBy("window", value).agg(F.sum("n").alias("n"))


def _covering(panes: DataFrame, spec: WindowSpec, total: DataFrame) -> DataFrame:
    """``panes`` (pane, ...) once for each full window that holds them, with ``window``."""
    per = spec.width // spec.stride
    last = F.floor((F.col("n_vehicles") - spec.warmup - spec.width) / spec.stride)
    panes = panes.crossJoin(F.broadcast(total)).withColumns({"__lo": F.greatest(F.lit(0), F.col("pane") - per + 1), "__hi": F.least(F.col("pane"), last)})
    return panes.where("__lo <= __hi").withColumn("window", F.explode(F.sequence("__lo", "__hi")))


def window_aggregate(df: DataFrame, spec: WindowSpec, channels: list[str], total: DataFrame) -> DataFrame:
    """(window, station, <channel>_{mean,std,max,min,count}) of each channel.

    Rows are first summed by pane of ``stride`` vehicles, then each pane is added to the width / stride windows that hold
    it, so a row is not copied for every window. Width must be a multiple of stride; else rows are copied.
    """
    v = F.col("vehicle_id") - spec.warmup
    if spec.width % spec.stride:
        rows = in_windows(df, spec, total)
        return rows.groupBy("window", "station").agg(*[f(c).alias(f"{c}_{n}") for c in channels for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min), ("count", F.count))])
    part = [f for c in channels for f in (F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q"), F.max(c).alias(f"{c}_hi"), F.min(c).alias(f"{c}_lo"))]
    # Neighbouring panes share a task, so most of a window's sum is taken before it is shuffled.
    pane = F.floor(v / spec.stride)
    near = df.where(v >= 0).select("station", *channels, pane.alias("pane"), F.floor(pane / PANES).alias("__near")).repartition("__near")
    panes = _covering(near.groupBy("__near", "pane", "station").agg(*part), spec, total)
    out = []
    for c in channels:
        n, s, q = F.sum(f"{c}_n"), F.sum(f"{c}_s"), F.sum(f"{c}_q")
        out += [(s / F.nullif(n, F.lit(0))).alias(f"{c}_mean"), F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).alias(f"{c}_std"), F.max(f"{c}_hi").alias(f"{c}_max"), F.min(f"{c}_lo").alias(f"{c}_min"), n.alias(f"{c}_count")]
    return panes.groupBy("window", "station").agg(*out)
