"""Quality state by window and station, its alerts, and the risk of single visits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import baseline as B
from taktwerk.operators import decide as D
from taktwerk.operators import quality as K
from taktwerk.operators.quantiles import exact_medians, exact_quantiles
from taktwerk.plans import flow
from taktwerk.plans.base import Query, i, plain, r, tidy
from taktwerk.sources import fixtures as X

#: Vehicles pooled for a test, between two tests, and the fewest tested; limits of an alert.
POOL, STEP, LEAST = 200, 200, 20
LEAST_LLR, LEAST_M, ROWS = 0.5, 1.2, 3
#: Weights of the visit's evidence and confidence by tier. Fixed values.
W_PROC, W_CHANNEL, RICH, BASIC = 0.30, 0.85, 0.85, 0.45
_GRID = K.multiplier_grid()


def _brands(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Defects whose code is in a station's profile: the brands."""
    return K.explode_defects(X.inspections(spark, sf_dir, keep)).where("defect_type LIKE 'Brand%'")


def _profile(spark: SparkSession, sf_dir: str, defects: DataFrame) -> DataFrame:
    weight = F.pmod(F.col("station") * 7 + F.substring("defect_type", 7, 2).cast("int") * 3, F.lit(5)).cast("double")
    return defects.select("defect_type").distinct().crossJoin(X.stations(spark, sf_dir).select("station")).select("station", "defect_type", weight.alias("weight")).where("weight > 0")


def _panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands found, by panes of ``STEP`` vehicles: rates and pools are both summed from them, and the inspections are projected once a query."""
    return settled(K.pane_counts(_brands(spark, sf_dir, settled), STEP))


def _n_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles are the orders, numbered without gaps: to count them needs no numbers."""
    return X.table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n_vehicles"))


def _expected(spark: SparkSession, sf_dir: str, panes: DataFrame | None = None) -> DataFrame:
    """(station, defect_type, m): expected defects a vehicle, the station's rate times its profile over its sum."""
    d = _panes(spark, sf_dir) if panes is None else panes
    profile = _profile(spark, sf_dir, d)
    rate = K.nominal_rate(K.pane_mass(d, K.candidate_prior(profile)), X.stations(spark, sf_dir), _n_vehicles(spark, sf_dir))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("station"))
    return profile.withColumn("w", share).join(rate, "station").select("station", "defect_type", F.round(F.col("rate") * F.col("w"), 12).alias("m"))


def expected_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_expected(spark, sf_dir))


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n_vehicles(spark, sf_dir).where(F.col("n_vehicles") >= STEP)
    return n.select(F.explode(F.sequence(F.lit(0), F.floor(F.col("n_vehicles") / STEP) - 1)).alias("window")).select("window", ((F.col("window") + 1) * STEP).alias("v_end"))


def _pooled(spark: SparkSession, sf_dir: str, panes: DataFrame) -> DataFrame:
    return K.pooled_counts(panes, _pools(spark, sf_dir), POOL, LEAST, STEP)


def pooled_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_pooled(spark, sf_dir, _panes(spark, sf_dir)))


def _state(spark: SparkSession, sf_dir: str, panes: DataFrame | None = None) -> DataFrame:
    panes = _panes(spark, sf_dir) if panes is None else panes
    return settled(K.poisson_profile(_pooled(spark, sf_dir, panes), settled(_expected(spark, sf_dir, panes))))


def quality_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood ratio and best multiplier of every station's own defects, by pool."""
    return tidy(_state(spark, sf_dir), 5)


def quality_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _state(spark, sf_dir).withColumns({"llr": F.round("llr", 5), "m_hat": F.round("m_hat", 5)})
    return tidy(K.rolling_alerts(d, LEAST_LLR, LEAST_M, ROWS).select("window", "station", "quality_alert"))


def _ranking(spark: SparkSession, sf_dir: str, panes: DataFrame | None = None) -> DataFrame:
    d = _state(spark, sf_dir, panes).groupBy("station").agg(F.avg(F.round("llr", 5)).alias("mean_llr"), F.avg(F.round("m_hat", 5)).alias("m_hat"))
    return d.withColumns({"mean_llr": F.round("mean_llr", 4), "m_hat": F.round("m_hat", 4)}).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_llr"), "station")))


def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stations of highest mean likelihood ratio."""
    return tidy(_ranking(spark, sf_dir).where("rank <= 5"), 4)


def quality_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each station; at stake are the extra units on the way to the next gate."""
    panes = _panes(spark, sf_dir)
    ranking = settled(_ranking(spark, sf_dir, panes))
    d = ranking.join(_exposure(spark, sf_dir, ranking, panes).select("station", F.round("extra_units", 4).alias("at_risk")), "station", "left")
    return tidy(D.quality_recommendation(d, LEAST_M).select("station", "rank", "action", "priority", "abstained", "confidence"), 4)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with its z of processing time (against variant and station) and of the two waiting channels, which stand for process channels on RICH stations."""
    tel = settled(X.telemetry(spark, sf_dir).select("vehicle_id", "station", "variant", "proc_time_s", "blocked_s", "starved_s"))
    proc = B.variant_medians(tel)
    resid = tel.join(proc, ["station", "variant"]).withColumn("resid", F.col("proc_time_s") - F.col("proc"))
    d = resid.join(B.robust_scale(resid, ["station"], "resid", 0.30, 8).select("station", F.col("center").alias("rc"), F.col("scale").alias("rs")), "station")
    for c in ("blocked_s", "starved_s"):
        d = d.join(process_scale(tel, c).select("station", F.col("center").alias(f"{c}_c"), F.col("scale").alias(f"{c}_s")), "station", "left")
    rich = F.col("station") % 2 == 0
    z = {f"z_{c}": F.when(rich, (F.col(c) - F.col(f"{c}_c")) / F.col(f"{c}_s")) for c in ("blocked_s", "starved_s")}
    d = d.withColumns({"z_proc": (F.col("resid") - F.col("rc")) / F.col("rs"), **z})
    held = F.filter(F.array("z_blocked_s", "z_starved_s"), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))
    combined = W_PROC * F.greatest(F.lit(0.0), F.col("z_proc")) + W_CHANNEL * F.greatest(F.lit(0.0), F.coalesce(mean, F.lit(0.0)))
    return settled(d.select("vehicle_id", "station", "z_proc", (F.size(held) > 0).alias("rich"), F.round(combined, 6).alias("combined")))


def process_scale(tel: DataFrame, channel: str, least: int = 20, floor: float = 0.05) -> DataFrame:
    """(station, n, center, scale) of a raw channel: stations with fewer than ``least`` readings have none."""
    return B.robust_scale(tel, ["station"], channel, floor, 1).where(F.col("n") >= least)


def process_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(process_scale(X.telemetry(spark, sf_dir), "blocked_s"))


def _calibrated(evidence: DataFrame) -> DataFrame:
    """(bias, scale) of the logistic that puts 0.5 at four standard deviations over the mean."""
    sd = F.greatest(F.stddev_pop("combined"), F.lit(1e-6))
    d = evidence.agg(F.avg("combined").alias("mu"), sd.alias("sd"), F.count(F.lit(1)).alias("n"))
    slope = F.when(F.col("n") >= 20, 2.94 / (4 * F.col("sd"))).otherwise(1.0)
    return d.select(slope.alias("slope"), F.when(F.col("n") >= 20, -(2.94 / (4 * F.col("sd"))) * (F.col("mu") + 4 * F.col("sd"))).otherwise(-3.2).alias("bias"))


def risk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_calibrated(_evidence(spark, sf_dir)), 5)


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("slope") * F.col("combined") + F.col("bias")))
    d = e.crossJoin(F.broadcast(_calibrated(e))).withColumn("risk", 1 / (1 + F.exp(-x)))
    ceiling: Column = F.when(F.col("rich"), RICH).otherwise(BASIC)
    return d.withColumn("confidence", ceiling * F.least(F.lit(1.0), 0.5 + 0.5 * F.col("risk")))


def defect_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of every visit at a station with sensors, its likely defect, the gate that would find it and the confidence its station's tier allows."""
    kind = _profile(spark, sf_dir, _brands(spark, sf_dir)).groupBy("station").agg(F.max_by("defect_type", F.struct("weight", -F.substring("defect_type", 7, 2).cast("int"))).alias("defect_type"))
    gate = F.when(F.col("station") < X.GATE, X.GATE)
    d = _risk(spark, sf_dir).join(kind, "station", "left")
    return tidy(d.select("vehicle_id", "station", "risk", "defect_type", gate.alias("gate_station"), "confidence"), 4)


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations where risk cannot be told, as they give no process data."""
    return tidy(X.stations(spark, sf_dir).where("tier = 'MANUAL'").select("station", "station_id", "zone"))


def naive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects a vehicle by code, and the codes above the 99.5 % quantile of the rates."""
    n = X.vehicles(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_vehicles"))
    d = K.explode_defects(X.inspections(spark, sf_dir)).groupBy("defect_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n))
    d = settled(d.select("defect_type", F.round(F.col("n") / F.col("n_vehicles"), 9).alias("rate")))
    cut = exact_quantiles(d, [], "rate", {"cut": 0.995}).select(F.round("cut", 9).alias("cut"))
    return tidy(d.crossJoin(F.broadcast(cut)).withColumn("flagged", F.col("rate") > F.col("cut")))


def _exposure(spark: SparkSession, sf_dir: str, ranking: DataFrame, panes: DataFrame) -> DataFrame:
    """(station, units_on_the_way, extra_units): the line moves one unit a takt and station, so as many units are on the way to the gate as there are stations to it."""
    rate = _expected(spark, sf_dir, panes).groupBy("station").agg(F.sum("m").alias("rate"))
    way = F.greatest(F.lit(0), F.lit(X.GATE) - F.col("station"))
    more = F.greatest(F.lit(0.0), F.col("m_hat") - 1)
    return ranking.select("station", "m_hat").join(rate, "station").select("station", way.alias("units_on_the_way"), (way * F.col("rate") * more).alias("extra_units"))


def defect_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected extra defective units between each station and the next gate."""
    panes = _panes(spark, sf_dir)
    return tidy(_exposure(spark, sf_dir, _ranking(spark, sf_dir, panes), panes), 4)


def median_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median cycle of each station, and the pair of neighbours without sensors."""
    t = X.passes(spark, sf_dir).withColumn("cycle_s", F.round(F.col("proc_time_s") + F.col("blocked_s") + F.col("starved_s"), 9))
    return tidy(exact_medians(t, ["station"], "cycle_s", "median_cycle_s"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (expected_matrix, pooled_defects, quality_state, quality_alerts, quality_ranking, quality_recommendation, process_baseline, risk_calibration, defect_risk, coverage_gaps, naive_rate, defect_exposure, median_cycle)
}

_D = "alld AS (SELECT vehicle_id, gate_station, trim(defect_type) AS defect_type FROM (SELECT vehicle_id, station AS gate_station, unnest(string_split(defect_types, '|')) AS defect_type FROM inspections WHERE result = 'FAIL') WHERE trim(defect_type) <> ''), defects AS (SELECT * FROM alld WHERE defect_type LIKE 'Brand%')"
_W = "profile AS MATERIALIZED (SELECT station, defect_type, CAST((station * 7 + substr(defect_type, 7, 2)::INT * 3) % 5 AS DOUBLE) AS weight FROM stations, (SELECT DISTINCT defect_type FROM defects) WHERE (station * 7 + substr(defect_type, 7, 2)::INT * 3) % 5 > 0)"
_E = """prior AS (SELECT *, weight / sum(weight) OVER (PARTITION BY defect_type) AS prior FROM profile),
rates AS (SELECT s.station, (coalesce(m, 0) + 0.5) / ((SELECT count(*) FROM vehicles) + 1) AS rate FROM stations s LEFT JOIN (SELECT station, sum(mass) AS m FROM (SELECT p.station, prior / sum(prior) OVER (PARTITION BY vehicle_id, gate_station, d.defect_type) AS mass FROM defects d JOIN prior p ON p.defect_type = d.defect_type AND p.station < d.gate_station) GROUP BY station) a ON a.station = s.station),
expected AS MATERIALIZED (SELECT station, defect_type, round(rate * w, 12) AS m FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY station) AS w FROM profile) JOIN rates USING (station))"""
_O = f"""pools AS (SELECT w AS "window", {STEP} * (w + 1) AS v_end, {STEP} * w AS v_from FROM (SELECT unnest(range(0, (max(vehicle_id) + 1) // {STEP})) AS w FROM vehicles)),
counts AS MATERIALIZED (SELECT p."window", t.defect_type, {POOL} AS n, (SELECT count(*) FROM defects d WHERE d.defect_type = t.defect_type AND d.vehicle_id >= p.v_from AND d.vehicle_id < p.v_end) AS o FROM pools p, (SELECT DISTINCT defect_type FROM defects) t)"""
_S = f"""grid AS (SELECT unnest([{', '.join(repr(x) + '::DOUBLE' for x in _GRID)}]) AS mult), tot AS (SELECT defect_type, sum(m) AS m_all FROM expected GROUP BY defect_type),
ll AS MATERIALIZED (SELECT "window", e.station, mult, round(sum(o * ln(greatest(greatest(n * m_all, 1e-9) + (mult - 1) * n * e.m, 1e-9)) - greatest(greatest(n * m_all, 1e-9) + (mult - 1) * n * e.m, 1e-9)), 9) AS ll FROM counts c JOIN expected e USING (defect_type) JOIN tot USING (defect_type) CROSS JOIN grid GROUP BY "window", e.station, mult),
qs AS MATERIALIZED (SELECT "window", station, greatest(0, max(ll) - max(CASE WHEN mult = 1 THEN ll END)) AS llr, arg_max(mult, (ll, -mult)) AS m_hat FROM ll GROUP BY "window", station)"""
_Q = (_D, _W, _E, _O, _S)
_RANK = """ranked AS (SELECT *, row_number() OVER (ORDER BY mean_llr DESC, station) AS rank FROM (SELECT station, round(avg(round(llr, 5)), 4) AS mean_llr, round(avg(round(m_hat, 5)), 4) AS m_hat FROM qs GROUP BY station))"""
_WHOLE = "SELECT station, count(v) AS n, median(v) AS c FROM src GROUP BY station"
_V = f"""vm AS (SELECT station, variant, median(proc_time_s) AS proc FROM telemetry GROUP BY station, variant), rr AS MATERIALIZED (SELECT t.*, proc_time_s - proc AS resid FROM telemetry t JOIN vm USING (station, variant)),
rc AS (SELECT station, median(resid) AS c, count(*) AS n FROM rr GROUP BY station), rs AS (SELECT station, any_value(c) AS c, CASE WHEN any_value(n) < 8 THEN 0.30 ELSE greatest(median(abs(resid - c)) * 1.4826, 0.30) END AS s FROM rr JOIN rc USING (station) GROUP BY station),
bc AS (SELECT station, median(blocked_s) AS c, median(starved_s) AS d, count(*) AS n FROM telemetry GROUP BY station), bs AS (SELECT station, any_value(c) AS c, greatest(median(abs(blocked_s - c)) * 1.4826, 0.05) AS s, any_value(d) AS d, greatest(median(abs(starved_s - d)) * 1.4826, 0.05) AS t, any_value(n) AS n FROM telemetry JOIN bc USING (station) GROUP BY station),
ev AS MATERIALIZED (SELECT vehicle_id, rr.station, rr.station % 2 = 0 AS rich, round({W_PROC}::DOUBLE * greatest(0, (resid - rs.c) / rs.s) + CASE WHEN rr.station % 2 = 0 THEN {W_CHANNEL}::DOUBLE * greatest(0, ((blocked_s - bs.c) / bs.s + (starved_s - bs.d) / bs.t) / 2) ELSE 0 END, 6) AS combined FROM rr JOIN rs ON rs.station = rr.station JOIN bs ON bs.station = rr.station),
cal AS (SELECT 2.94::DOUBLE / (4 * greatest(stddev_pop(combined), 1e-6)) AS slope, -(2.94::DOUBLE / (4 * greatest(stddev_pop(combined), 1e-6))) * (avg(combined) + 4 * greatest(stddev_pop(combined), 1e-6)) AS bias FROM ev),
rk AS (SELECT ev.*, 1 / (1 + exp(-greatest(-30, least(30, slope * combined + bias)))) AS risk FROM ev, cal)"""

SQL: dict[str, str] = {
    "expected_matrix": plain(f"SELECT {i('station')} AS station, defect_type, {r('m')} AS m FROM expected", _D, _W, _E),
    "pooled_defects": plain(f"""SELECT "window", defect_type, n, {i('o')} AS o FROM counts""", _D, _O),
    "quality_state": plain(f"""SELECT "window", {i('station')} AS station, {r('llr', 5)} AS llr, {r('m_hat', 5)} AS m_hat FROM qs""", *_Q),
    "quality_alerts": plain(f"""SELECT "window", {i('station')} AS station, sum(CASE WHEN round(llr, 5) >= {LEAST_LLR} AND round(m_hat, 5) >= {LEAST_M} THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY "window" ROWS BETWEEN {ROWS - 1} PRECEDING AND CURRENT ROW) = {ROWS} AS quality_alert FROM qs""", *_Q),
    "quality_ranking": plain(f"SELECT {i('station')} AS station, {r('mean_llr', 4)} AS mean_llr, {r('m_hat', 4)} AS m_hat, rank FROM ranked WHERE rank <= 5", *_Q, _RANK),
    "quality_recommendation": plain(f"""SELECT {i('station')} AS station, rank, CASE WHEN weak THEN 'ESCALATE_AMBIGUOUS' ELSE 'TARGETED_QUALITY_CHECK' END AS action, CASE WHEN weak THEN 'LOW' WHEN round(greatest(0, {X.GATE} - station) * rate * greatest(0, m_hat - 1), 4) >= 3 AND rank = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, weak AS abstained, {r('1.0::DOUBLE / rank', 4)} AS confidence FROM (SELECT k.*, e.rate, rank > 3 OR m_hat < {LEAST_M} AS weak FROM ranked k LEFT JOIN (SELECT station, sum(m) AS rate FROM expected GROUP BY station) e ON e.station = k.station)""", *_Q, _RANK),
    "process_baseline": plain(f"SELECT {i('station')} AS station, n, {r('c')} AS center, {r('s')} AS scale FROM bs WHERE n >= 20", _V),
    "risk_calibration": plain(f"SELECT {r('slope', 5)} AS slope, {r('bias', 5)} AS bias FROM cal", _V),
    "defect_risk": plain(f"""SELECT vehicle_id, {i('rk.station')} AS station, {r('risk', 4)} AS risk, defect_type, CASE WHEN rk.station < {X.GATE} THEN {X.GATE}::BIGINT END AS gate_station, {r(f'CASE WHEN rich THEN {RICH} ELSE {BASIC} END::DOUBLE * least(1, 0.5 + 0.5 * risk)', 4)} AS confidence
      FROM rk LEFT JOIN (SELECT station, arg_max(defect_type, (weight, -substr(defect_type, 7, 2)::INT)) AS defect_type FROM profile GROUP BY station) p ON p.station = rk.station""", _V, _D, _W),
    "coverage_gaps": plain(f"SELECT {i('station')} AS station, station_id, zone FROM stations WHERE tier = 'MANUAL'"),
    "naive_rate": plain(f"SELECT defect_type, {r('rate')} AS rate, {r('cut')} AS cut, rate > cut AS flagged FROM nr, (SELECT round(quantile_cont(rate, 0.995), 9) AS cut FROM nr)", _D, "nr AS (SELECT defect_type, round(count(*) / (SELECT count(*) FROM vehicles), 9) AS rate FROM alld GROUP BY defect_type)"),
    "defect_exposure": plain(f"SELECT {i('station')} AS station, {i('way')} AS units_on_the_way, {r('way * rate * greatest(0, m_hat - 1)', 4)} AS extra_units FROM (SELECT k.station, m_hat, greatest(0, {X.GATE} - k.station) AS way, e.rate FROM ranked k JOIN (SELECT station, sum(m) AS rate FROM expected GROUP BY station) e ON e.station = k.station)", *_Q, _RANK),
    "median_cycle": plain(f"SELECT {i('station')} AS station, count(*) AS n, {r('median(round(proc_time_s + blocked_s + starved_s, 9))')} AS median_cycle_s FROM passes GROUP BY station"),
}
