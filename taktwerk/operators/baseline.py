"""The frozen baseline: robust centres and scales of nominal runs, and deviations from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.operators.quantiles import exact_medians

#: MAD to standard deviation.
MAD_SCALE = 1.4826


def robust_scale(df: DataFrame, by: list[str], value: str, floor: float, least: int = 1) -> DataFrame:
    """(by..., n, center, scale) of a value: median, and median absolute deviation x 1.4826, at least ``floor``; below ``least`` rows the floor."""
    rows = df.where(F.col(value).isNotNull())
    centers = exact_medians(rows, by, value, "center")
    away = rows.join(centers.select(*by, "center"), by).select(*by, F.abs(F.col(value) - F.col("center")).alias("away"))
    scale = F.when(F.col("n") < least, F.lit(floor)).otherwise(F.greatest(F.col("mad") * MAD_SCALE, F.lit(floor)))
    return centers.join(exact_medians(away, by, "away", "mad").drop("n"), by).select(*by, "n", "center", scale.alias("scale"))


def variant_medians(tel: DataFrame) -> DataFrame:
    """(station, variant, proc): the median processing time."""
    return exact_medians(tel, ["station", "variant"], "proc_time_s", "proc").drop("n")


def shift_factors(tel: DataFrame) -> DataFrame:
    """(station, shift, factor): a shift's median over the station's; rows without shift are left out."""
    known = tel.where("proc_time_s IS NOT NULL")
    whole = exact_medians(known, ["station"], "proc_time_s", "m").drop("n")
    each = exact_medians(known.where("shift IS NOT NULL"), ["station", "shift"], "proc_time_s", "s").drop("n")
    return each.join(whole, "station").where("m > 0").select("station", "shift", (F.col("s") / F.col("m")).alias("factor"))


def expected_proc(mix: DataFrame, shift: DataFrame, medians: DataFrame, factors: DataFrame) -> DataFrame:
    """(window, station, expected): the mix-weighted medians of a window's variants, times its shift's factor (1 where there is none).

    A variant that the station has not seen counts with the mean of the station's medians. ``mix``: (window, variant, share)."""
    usual = medians.groupBy("station").agg(F.avg("proc").alias("usual"))
    grid = mix.crossJoin(F.broadcast(usual)).join(F.broadcast(medians), ["station", "variant"], "left")
    proc = F.coalesce("proc", "usual")
    blend = grid.groupBy("window", "station").agg((F.sum(F.col("share") * proc) / F.sum("share")).alias("blend"))
    out = blend.join(shift, "window", "left").join(F.broadcast(factors), ["station", "shift"], "left")
    return out.select("window", "station", (F.col("blend") * F.coalesce("factor", F.lit(1.0))).alias("expected"))


def variant_mix(tel_windows: DataFrame) -> DataFrame:
    """(window, variant, share) over the distinct vehicles of each window."""
    seen = tel_windows.select("window", "vehicle_id", "variant").distinct()
    return mix_of(seen.groupBy("window", "variant").agg(F.count(F.lit(1)).alias("n")))


def mix_of(counts: DataFrame) -> DataFrame:
    """``variant_mix`` from (window, variant, n)."""
    return counts.select("window", "variant", (F.col("n") / F.sum("n").over(Window.partitionBy("window"))).alias("share"))


def dominant_shift(vehicle_windows: DataFrame) -> DataFrame:
    """(window, shift): the most frequent shift of a window, the smallest on ties."""
    return dominant_of(vehicle_windows.where("shift IS NOT NULL").groupBy("window", "shift").agg(F.count(F.lit(1)).alias("n")))


def dominant_of(counts: DataFrame) -> DataFrame:
    """``dominant_shift`` from (window, shift, n) without null shifts."""
    return counts.groupBy("window").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))


def takt_deviation(windows: DataFrame, takt_s: float, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """(scored windows, station centres): blocked and starved shares of the takt less their station's median, rounded before any test."""
    frac = {c: F.col(f"{c}_s_mean") / takt_s for c in ("blocked", "starved")}
    w = windows.withColumns({f"{c}_frac": v for c, v in frac.items()})
    # Both channels in one pass.
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_frac").alias("v")) for c in frac])).alias("x")
    medians = exact_medians(w.select("station", each).select("station", "x.c", "x.v"), ["station", "c"], "v", "m")
    centers = medians.groupBy("station").agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"{c}_center") for c in frac])
    d = {f"d_{c}": F.round(F.col(f"{c}_frac") - F.col(f"{c}_center"), digits) for c in frac}
    return w.join(F.broadcast(centers), "station").withColumns(d), centers


def z_score(value: Column, center: Column, scale: Column) -> Column:
    return (value - center) / scale
