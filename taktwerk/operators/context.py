"""A frozen context: what one run taught, kept as tables of its own and applied to another run.

A context is fitted on a nominal run, calibrated on a second one without disturbances, and written below a version; who scores a run reads it
back and is refused where the line, takt or window plan differ.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from taktwerk.operators import baseline as B
from taktwerk.operators import localise as L
from taktwerk.operators import runs as R
from taktwerk.operators.quantiles import exact_quantiles
from taktwerk.operators.windows import WindowSpec

#: Floors of the two scales, least rows of a scale, spreads if all stations' are 0, false-alarm targets, bounds of the thresholds.
PROC_FLOOR, FRACTION_FLOOR, LEAST_ROWS = 0.30, 0.015, 8
SIGMA_BLOCKED, SIGMA_STARVED = 0.03, 0.05
DETECT_RATE, WATCH_RATE, LEAST_DETECT, LEAST_WATCH, WATCH_SHARE, MOST_CORRELATED = 0.01, 0.05, 1.0, 0.25, 0.9, 0.98
CHANNELS = ("blocked", "starved")


@dataclass(frozen=True)
class Context:
    """Small tables by station, variant and shift, and the numbers of the line."""

    takt_s: float
    spec: WindowSpec
    proc: DataFrame
    factors: DataFrame
    stations: DataFrame
    sigma_blocked: float
    sigma_starved: float
    tau: float = 1.0
    detect: float = 8.0
    watch: float = 4.0
    noise: float = 1.0

    def numbers(self) -> dict[str, float]:
        return {n: float(getattr(self, n)) for n in ("takt_s", "sigma_blocked", "sigma_starved", "tau", "detect", "watch", "noise")} | {n: float(getattr(self.spec, n)) for n in ("width", "stride", "warmup")}


def fit_baseline(windows: DataFrame, telemetry: DataFrame, mix: DataFrame, shift: DataFrame, takt_s: float, spec: WindowSpec) -> Context:
    """Medians, centres and scales of a nominal run. ``windows``: its window means; ``mix`` and ``shift``: of its windows."""
    proc, factors = B.variant_medians(telemetry), B.shift_factors(telemetry)
    resid = windows.join(B.expected_proc(mix, shift, proc, factors), ["window", "station"]).select("station", F.round(F.col("proc_time_s_mean") - F.col("expected"), 9).alias("v"))
    shares = [windows.select("station", F.lit(c).alias("c"), (F.col(f"{c}_s_mean") / takt_s).alias("v")) for c in CHANNELS]
    stations = B.robust_scale(resid, ["station"], "v", PROC_FLOOR, LEAST_ROWS).select("station", F.col("center").alias("proc_center"), F.col("scale").alias("proc_scale"))
    both = B.robust_scale(shares[0].unionByName(shares[1]), ["station", "c"], "v", FRACTION_FLOOR, LEAST_ROWS)
    pick = [F.max(F.when(F.col("c") == c, F.col(x))).alias(f"{c}_{x}") for c in CHANNELS for x in ("center", "scale")]
    stations = stations.join(both.groupBy("station").agg(*pick), "station", "full")
    spreads = exact_quantiles(both.select("c", "scale"), ["c"], "scale", {"m": 0.5}).collect()  # one row a channel
    sigma = {r["c"]: r["m"] for r in spreads}
    return Context(takt_s, spec, proc, factors, stations, sigma.get("blocked") or SIGMA_BLOCKED, sigma.get("starved") or SIGMA_STARVED)


def score(ctx: Context, windows: DataFrame, mix: DataFrame, shift: DataFrame, digits: int = 9) -> DataFrame:
    """(window, station, z_proc, d_blocked, d_starved) of a run's windows against ``ctx``; stations that the context does not know have no deviations."""
    d = windows.join(B.expected_proc(mix, shift, ctx.proc, ctx.factors), ["window", "station"], "left").join(F.broadcast(ctx.stations), "station", "left")
    resid = F.round(F.col("proc_time_s_mean") - F.col("expected"), digits)
    out = [F.round((resid - F.col("proc_center")) / F.col("proc_scale"), digits).alias("z_proc")]
    out += [F.round(F.col(f"{c}_s_mean") / ctx.takt_s - F.col(f"{c}_center"), digits).alias(f"d_{c}") for c in CHANNELS]
    return d.select("window", "station", *out)


def correlation_share(scored: DataFrame) -> float:
    """tau: the share of independent observations among the stations, from the mean correlation of their pressures; 1 where fewer than three stations or ten windows speak.

    A station with a gap or without any change does not count. Windows are read once: each gives its pairs of stations, which are as many as the line is long."""
    d = scored.withColumn("p", F.col("d_blocked") - F.col("d_starved"))
    n = d.agg(F.countDistinct("window")).first()[0]
    steady = d.groupBy("station").agg(F.count("p").alias("n"), F.stddev_samp("p").alias("sd"), F.avg("p").alias("m")).where((F.col("n") == n) & (F.col("sd") > 1e-9 * F.greatest(F.lit(1.0), F.abs("m"))))
    stations = steady.count()
    if stations < 3 or n < 10:
        return 1.0
    row = d.join(F.broadcast(steady.select("station")), "station").groupBy("window").agg(F.collect_list(F.struct("station", "p")).alias("l"))  # one entry a station
    pairs = row.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a.station < b.station")
    rho = pairs.groupBy("a.station", F.col("b.station").alias("other")).agg(F.corr("a.p", "b.p").alias("rho")).agg(F.avg("rho")).first()[0]
    rho = min(max(rho or 0.0, 0.0), MOST_CORRELATED)
    return min(max(1 / (1 + (stations - 1) * rho), 1e-3), 1.0)


def posterior(ctx: Context, scored: DataFrame, prop: DataFrame, n_stations: int, alpha: float = 0.55) -> DataFrame:
    """The smoothed posterior of a run's windows; smoothing starts with the run."""
    s = L.llr(L.hypothesis_scores(scored, prop, ctx.sigma_blocked, ctx.sigma_starved, ctx.tau))
    smooth = R.ewma(s.where("k >= 0").select("window", "k", "llr"), ["k"], "window", "llr", "llr_s", alpha)
    return L.posterior(smooth.unionByName(s.where("k < 0").select("window", "k", "llr", F.col("llr").alias("llr_s"))), n_stations)


def thresholds(ctx: Context, post: DataFrame) -> Context:
    """``ctx`` with detection, watch and noise read off the leading candidates of a run without disturbances."""
    top = L.top_and_runner_up(post).select("window", F.col("top_station").alias("k"))
    lead = post.join(top, ["window", "k"]).select(F.round("llr_s", 9).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    row = exact_quantiles(lead, [], "v", {"q": 1 - DETECT_RATE, "w": 1 - WATCH_RATE}).first()
    if row is None or row["q"] is None:
        return ctx
    detect = max(row["q"], LEAST_DETECT)
    noise = lead.agg(F.when(F.count("v") >= 2, F.stddev_pop("v"))).first()[0]
    return replace(ctx, detect=detect, watch=min(max(min(row["w"], WATCH_SHARE * detect), LEAST_WATCH), detect), noise=1.0 if noise is None else noise)


def save(ctx: Context, root: str, version: str) -> None:
    """Writes the context below ``root``; a version is written once."""
    for name in ("proc", "factors", "stations"):
        getattr(ctx, name).write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    ctx.proc.sparkSession.createDataFrame(sorted(ctx.numbers().items()), "name string, value double").coalesce(1).write.mode("errorifexists").parquet(f"{root}/{version}/numbers")


def load(spark: SparkSession, root: str, version: str, *, takt_s: float, spec: WindowSpec) -> Context:
    """The context of ``version``, for a run of this takt and window plan; others are refused."""
    try:
        numbers = {r["name"]: r["value"] for r in spark.read.parquet(f"{root}/{version}/numbers").collect()}
    except AnalysisException as e:
        raise LookupError(f"no context of version {version} below {root}") from e
    for name, want in {"takt_s": takt_s, "width": spec.width, "stride": spec.stride, "warmup": spec.warmup}.items():
        if numbers[name] != float(want):
            raise ValueError(f"the context was fitted with {name} {numbers[name]:g}, this run has {want:g}")
    tables = {n: spark.read.parquet(f"{root}/{version}/{n}") for n in ("proc", "factors", "stations")}
    return Context(takt_s, spec, **tables, **{n: numbers[n] for n in ("sigma_blocked", "sigma_starved", "tau", "detect", "watch", "noise")})
