"""Defects found at gates, traced back to the stations that may have caused them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explode_defects(inspections: DataFrame) -> DataFrame:
    """(vehicle_id, gate_station, defect_type, t_found_s): one row a code of a failed inspection; blank codes are none."""
    rows = inspections.where("result = 'FAIL'").select("vehicle_id", F.col("station").alias("gate_station"), F.explode(F.split("defect_types", r"\|")).alias("defect_type"), F.col("t_s").alias("t_found_s"))
    return rows.withColumn("defect_type", F.trim("defect_type")).where("defect_type <> ''")


def candidate_prior(profile: DataFrame) -> DataFrame:
    """(station, defect_type, prior): weights of (station, defect_type, weight) over their sum for the type."""
    total = F.sum("weight").over(Window.partitionBy("defect_type"))
    return profile.where("weight > 0").select("station", "defect_type", (F.col("weight") / total).alias("prior"))


def _shares(kinds: DataFrame, prior: DataFrame) -> DataFrame:
    """(gate_station, defect_type, station, share) of the stations before each gate, by prior."""
    usable = kinds.join(prior, "defect_type").where("station < gate_station")
    share = F.col("prior") / F.sum("prior").over(Window.partitionBy("gate_station", "defect_type"))
    return usable.select("gate_station", "defect_type", "station", share.alias("share"))


def attribute(defects: DataFrame, prior: DataFrame) -> DataFrame:
    """(vehicle_id, gate_station, defect_type, station, mass): each defect shared by the stations before its gate, by prior; equal defects of a vehicle at a gate share one.

    The shares of a (gate, type) are the same for all its defects, so they are worked out on the dimension and joined."""
    shares = _shares(defects.select("gate_station", "defect_type").distinct(), prior)
    equal = F.count(F.lit(1)).over(Window.partitionBy("vehicle_id", "gate_station", "defect_type"))
    each = defects.select("vehicle_id", "gate_station", "defect_type", equal.alias("n")).join(shares, ["gate_station", "defect_type"])
    return each.select("vehicle_id", "gate_station", "defect_type", "station", (F.col("share") / F.col("n")).alias("mass"))


def pane_counts(defects: DataFrame, pane: int) -> DataFrame:
    """(pane, gate_station, defect_type, o, units): defects, and vehicles that have one, of each ``pane`` vehicles in a row.

    Defects are dealt by pane once; a vehicle's and a pane's are then summed where they lie."""
    near = defects.select("vehicle_id", "gate_station", "defect_type", F.floor(F.col("vehicle_id") / pane).alias("pane")).repartition("pane")
    per = near.groupBy("pane", "vehicle_id", "gate_station", "defect_type").agg(F.count(F.lit(1)).alias("o"))
    return per.groupBy("pane", "gate_station", "defect_type").agg(F.sum("o").alias("o"), F.count(F.lit(1)).alias("units"))


def pane_mass(panes: DataFrame, prior: DataFrame) -> DataFrame:
    """(gate_station, defect_type, station, mass): the sums of ``attribute``. Equal defects of a vehicle at a gate share one, so a vehicle counts once, and the defects themselves are not needed."""
    kinds = panes.groupBy("gate_station", "defect_type").agg(F.sum("units").alias("units"))
    return kinds.join(_shares(kinds.select("gate_station", "defect_type"), prior), ["gate_station", "defect_type"]).select("gate_station", "defect_type", "station", (F.col("share") * F.col("units")).alias("mass"))


def nominal_rate(attributed: DataFrame, stations: DataFrame, n_vehicles: int | DataFrame) -> DataFrame:
    """(station, rate): (mass + 0.5) / (vehicles + 1) of every station, with or without defects."""
    mass = attributed.groupBy("station").agg(F.sum("mass").alias("mass"))
    n = n_vehicles if isinstance(n_vehicles, DataFrame) else None
    out = stations.select("station").join(mass, "station", "left")
    if n is not None:
        return out.crossJoin(F.broadcast(n)).select("station", ((F.coalesce("mass", F.lit(0.0)) + 0.5) / (F.col("n_vehicles") + 1)).alias("rate"))
    return out.select("station", ((F.coalesce("mass", F.lit(0.0)) + 0.5) / (n_vehicles + 1)).alias("rate"))


def pooled_counts(panes: DataFrame, windows: DataFrame, pool: int, least: int, pane: int) -> DataFrame:
    """(window, defect_type, n, o): defects of the vehicles of [v_end - pool, v_end) in each window of (window, v_end), for pools of ``least`` vehicles or more.

    ``panes`` as ``pane_counts`` gives them; ``pool`` and every ``v_end`` are whole panes. A pane, not a defect, is added to every window that pools it."""
    if pool % pane:
        raise ValueError("a pool must be whole panes")
    w = windows.select("window", "v_end", F.greatest(F.lit(0), F.col("v_end") - pool).alias("v_from")).withColumn("n", F.col("v_end") - F.col("v_from")).where(F.col("n") >= least)
    held = w.select("window", F.explode(F.sequence(F.floor(F.col("v_from") / pane), F.floor(F.col("v_end") / pane) - 1)).alias("pane"))
    sums = held.join(panes.select("pane", "defect_type", "o"), "pane").groupBy("window", "defect_type").agg(F.sum("o").alias("o"))
    asks = w.crossJoin(F.broadcast(panes.select("defect_type").distinct()))
    return asks.join(sums, ["window", "defect_type"], "left").select("window", "defect_type", "n", F.coalesce("o", F.lit(0)).alias("o"))


def multiplier_grid() -> list[float]:
    """41 points on [1, 6], then 30 on (6, 30]."""
    return [1 + 5 * k / 40 for k in range(41)] + [6.5 + 23.5 * k / 29 for k in range(30)]


def poisson_profile(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """(window, station, llr, m_hat): the best multiplier of each station's own defect rate, and what it gains over none.

    ``counts`` (window, defect_type, n, o); ``expected`` (station, defect_type, m): defects a vehicle. The log likelihood of a multiplier needs, of a type, only the
    pooled total of all stations and the station's part, so windows meet stations and grid by broadcast joins of dimensions. Counts are dealt by window before they meet
    the grid: both sums then find their rows in place, and the grid's copies are never shuffled. The number of partitions is given, as what they grow to is not seen in their size.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = F.explode(F.array(*[F.lit(m) for m in multiplier_grid()])).alias("mult")
    total = expected.groupBy("defect_type").agg(F.sum("m").alias("m_all"))
    inert = expected.groupBy("station").agg(F.sum("m").alias("m_sum"))
    dim = expected.join(total, "defect_type").join(inert, "station").select("station", "defect_type", "m", "m_all", "m_sum")
    rows = counts.repartition(parts, "window").join(F.broadcast(dim), "defect_type").select("window", "station", "n", "o", "m", "m_all", "m_sum", grid)
    e0 = F.greatest(F.col("n") * F.col("m_all"), F.lit(1e-9))
    e = F.greatest(e0 + (F.col("mult") - 1) * F.col("n") * F.col("m"), F.lit(1e-9))
    ll = rows.groupBy("window", "station", "mult").agg(F.round(F.sum(F.col("o") * F.ln(e) - e), 9).alias("ll"), F.max(F.col("n") * F.col("m_sum")).alias("weight"))
    best = ll.groupBy("window", "station").agg(F.max("ll").alias("top"), F.max_by("mult", F.struct("ll", -F.col("mult"))).alias("m_hat"), F.max(F.when(F.col("mult") == 1, F.col("ll"))).alias("ll0"), F.max("weight").alias("weight"))
    live = F.col("weight") >= 1e-6
    return best.select("window", "station", F.when(live, F.greatest(F.lit(0.0), F.col("top") - F.col("ll0"))).otherwise(0.0).alias("llr"), F.when(live, F.col("m_hat")).otherwise(1.0).alias("m_hat"))


def rolling_alerts(state: DataFrame, least_llr: float, least_m: float, rows: int = 3) -> DataFrame:
    """``state`` with ``quality_alert``: the station is over both limits in the last ``rows`` windows, all of them there."""
    w = Window.partitionBy("station").orderBy("window").rowsBetween(-(rows - 1), 0)
    hit = F.when((F.col("llr") >= least_llr) & (F.col("m_hat") >= least_m), 1).otherwise(0)
    return state.withColumn("__hit", hit).withColumn("quality_alert", F.sum("__hit").over(w) == rows).drop("__hit")


def interpolate_passes(passes: DataFrame, stations: DataFrame, order: str = "t_depart_s") -> DataFrame:
    """(vehicle_id, station, t_pass_s, is_interpolated) on the full grid: of repeated records the last by ``order`` that has a time; times at stations without a record are on the line between the neighbours', flat at the ends."""
    last = passes.groupBy("vehicle_id", "station").agg(F.max_by("t_depart_s", F.when(F.col("t_depart_s").isNotNull(), F.col(order))).alias("t"))
    grid = last.select("vehicle_id").distinct().crossJoin(F.broadcast(stations.select("station")))
    d = grid.join(last, ["vehicle_id", "station"], "left")
    w = Window.partitionBy("vehicle_id").orderBy("station")
    at = F.when(F.col("t").isNotNull(), F.struct("station", "t"))
    d = d.withColumns({"p": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("p.t") + (F.col("n.t") - F.col("p.t")) * (F.col("station") - F.col("p.station")) / (F.col("n.station") - F.col("p.station"))
    return d.select("vehicle_id", "station", F.coalesce("t", F.when(F.col("n.station") > F.col("p.station"), line), "p.t", "n.t").alias("t_pass_s"), F.col("t").isNull().alias("is_interpolated"))
