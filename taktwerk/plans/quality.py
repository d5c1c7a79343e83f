"""Quality-path and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators import quality as K
from taktwerk.plans.base import Query, i, plain, r, tidy
from taktwerk.sources import fixtures as X


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, defect_type, weight): a fixed rule over the codes that occur."""
    types = K.explode_defects(X.inspections(spark, sf_dir)).select("defect_type").distinct()
    weight = F.pmod(F.col("station") * 7 + F.length("defect_type") * 3, F.lit(5)).cast("double")
    return types.crossJoin(F.broadcast(X.stations(spark, sf_dir).select("station"))).select("station", "defect_type", weight.alias("weight"))


def explode_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by type and gate."""
    d = K.explode_defects(X.inspections(spark, sf_dir))
    return tidy(d.groupBy("gate_station", "defect_type").agg(F.count(F.lit(1)).alias("n"), F.min("t_found_s").alias("first_s")))


def candidate_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(K.candidate_prior(_profile(spark, sf_dir)))


def attribute_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of defects that each station is charged with, by type."""
    a = K.attribute(K.explode_defects(X.inspections(spark, sf_dir)), K.candidate_prior(_profile(spark, sf_dir)))
    return tidy(a.groupBy("station", "defect_type").agg(F.sum("mass").alias("mass")), 4)


def quality_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunken defect rate of every station."""
    a = K.attribute(K.explode_defects(X.inspections(spark, sf_dir)), K.candidate_prior(_profile(spark, sf_dir)))
    n = X.vehicles(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_vehicles"))
    return tidy(K.nominal_rate(a, X.stations(spark, sf_dir), n))


def gate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = F.count_if(F.col("result") == "FAIL")
    return tidy(X.inspections(spark, sf_dir).groupBy("station").agg(F.count(F.lit(1)).alias("n"), fails.alias("fails"), (fails / F.count(F.lit(1))).alias("fail_rate")))


def genealogy_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass time of every vehicle at every station, between neighbours where none was recorded."""
    return tidy(K.interpolate_passes(X.telemetry(spark, sf_dir), X.stations(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, p): returned lines and a stated probability in whole tenths."""
    lines = X.table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_returnflag") == "R").alias("y"), F.round(F.col("l_discount") * 100).cast("long").alias("t"))


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    miss = F.col("t") - 10 * F.col("y").cast("long")
    return tidy(_pairs(spark, sf_dir).agg((F.sum(miss * miss) / F.count(F.lit(1)) / 100).alias("brier"), F.count(F.lit(1)).alias("n")))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir).groupBy(F.least(F.lit(4), F.floor(F.col("t") / 2)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.sum("t") / F.count(F.lit(1)) / 10).alias("mean_p"), (F.count_if("y") / F.count(F.lit(1))).alias("rate"))
    every = spark.range(5).select(F.col("id").cast("int").alias("bin"))
    return every.join(d, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", (F.coalesce("n", F.lit(0)) >= 20).alias("reliable"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bins of probability, left-closed; empty ones stay."""
    return tidy(_bins(spark, sf_dir))


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error over the reliable bins and the share of pairs in them."""
    good = F.col("reliable")
    held = F.sum(F.when(good, F.col("n")).otherwise(0))
    return tidy(_bins(spark, sf_dir).agg((F.sum(F.when(good, F.col("n") * F.abs(F.col("mean_p") - F.col("rate")))) / held).alias("ece"), (held / F.sum("n")).alias("coverage")))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ratios of calling 0.6 and above a return; a ratio over nothing is null."""
    call, y = F.col("t") >= 6, F.col("y")
    c = _pairs(spark, sf_dir).agg(F.count_if(call & y).alias("tp"), F.count_if(call & ~y).alias("fp"), F.count_if(~call & y).alias("fn"), F.count_if(~call & ~y).alias("tn"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return tidy(c.select("tp", "fp", "fn", "tn", ratio("tp", tp + fp).alias("precision"), ratio("tp", tp + fn).alias("recall"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"), ratio("fp", fp + tn).alias("fpr")))


def precision_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace precision of each station's alerts and the weight that feedback gives it; open outcomes (O) do not count."""
    lines = X.table(spark, sf_dir, "lineitem").where("l_quantity >= 48 AND l_returnflag <> 'N'")
    g = lines.groupBy((F.col("l_linenumber") - 1).alias("station")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("confirmed"))
    g = g.withColumn("precision", (F.col("confirmed") + 1) / (F.col("n") + 2))
    p = F.col("precision")
    weight = F.when(p >= 0.5, 1 + (2.0 - 1) * (p - 0.5) / 0.5).otherwise(1 - (1 - 0.5) * (0.5 - p) / 0.5)
    return tidy(g.withColumn("weight", F.when(F.col("n") >= 3, F.greatest(F.lit(0.5), F.least(F.lit(2.0), weight))).otherwise(1.0)))


def magnitude_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean of a magnitude in right-closed bands."""
    m = F.round(1 + F.col("l_quantity") / 50, 4)
    band = F.when(m <= 1.2, "<=1.20").when(m <= 1.3, "1.20-1.30").when(m <= 1.5, "1.30-1.50").otherwise(">1.50")
    return tidy(X.table(spark, sf_dir, "lineitem").select(band.alias("band"), m.alias("m")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (explode_defects, candidate_prior, attribute_defects, quality_baseline, gate_rates, genealogy_interp, brier, reliability, ece, confusion, precision_by_station, magnitude_bands)}

_D = "defects AS (SELECT vehicle_id, gate_station, trim(defect_type) AS defect_type, t_s FROM (SELECT vehicle_id, station AS gate_station, unnest(string_split(defect_types, '|')) AS defect_type, t_s FROM inspections WHERE result = 'FAIL') WHERE trim(defect_type) <> '')"
_W = "profile AS (SELECT station, defect_type, CAST((station * 7 + length(defect_type) * 3) % 5 AS DOUBLE) AS weight FROM stations, (SELECT DISTINCT defect_type FROM defects)), prior AS (SELECT station, defect_type, weight / sum(weight) OVER (PARTITION BY defect_type) AS prior FROM profile WHERE weight > 0)"
_A = "attributed AS (SELECT d.vehicle_id, d.defect_type, p.station, prior / sum(prior) OVER (PARTITION BY d.vehicle_id, d.gate_station, d.defect_type) AS mass FROM defects d JOIN prior p ON p.defect_type = d.defect_type AND p.station < d.gate_station)"
_Y = "pairs AS (SELECT l_returnflag = 'R' AS y, CAST(round(l_discount * 100) AS BIGINT) AS t FROM lineitem)"
_BINS = "bins AS (SELECT b AS bin, coalesce(n, 0) AS n, mean_p, rate, coalesce(n, 0) >= 20 AS reliable FROM range(5) x(b) LEFT JOIN (SELECT least(4, t // 2) AS bin, count(*) AS n, avg(t) / 10 AS mean_p, avg(y::INT) AS rate FROM pairs GROUP BY 1) d ON d.bin = b)"
_C = "conf AS (SELECT count_if(t >= 6 AND y)::BIGINT AS tp, count_if(t >= 6 AND NOT y)::BIGINT AS fp, count_if(t < 6 AND y)::BIGINT AS fn, count_if(t < 6 AND NOT y)::BIGINT AS tn FROM pairs)"

SQL: dict[str, str] = {
    "explode_defects": plain(f"SELECT {i('gate_station')} AS gate_station, defect_type, count(*) AS n, {r('min(t_s)')} AS first_s FROM defects GROUP BY gate_station, defect_type", _D),
    "candidate_prior": plain(f"SELECT {i('station')} AS station, defect_type, {r('prior')} AS prior FROM prior", _D, _W),
    "attribute_defects": plain(f"SELECT {i('station')} AS station, defect_type, {r('sum(mass)', 4)} AS mass FROM attributed GROUP BY station, defect_type", _D, _W, _A),
    "quality_baseline": plain(f"SELECT {i('s.station')} AS station, {r('(coalesce(m, 0) + 0.5) / ((SELECT count(*) FROM vehicles) + 1)')} AS rate FROM stations s LEFT JOIN (SELECT station, sum(mass) AS m FROM attributed GROUP BY station) a ON a.station = s.station", _D, _W, _A),
    "gate_rates": plain(f"SELECT {i('station')} AS station, count(*) AS n, count_if(result = 'FAIL')::BIGINT AS fails, {r('count_if(result = $$FAIL$$) / count(*)')} AS fail_rate FROM inspections GROUP BY station"),
    "genealogy_interp": plain(f"""SELECT vehicle_id, {i('station')} AS station, {r('coalesce(t, CASE WHEN n.s > p.s THEN p.t + (n.t - p.t) * (station - p.s) / (n.s - p.s) END, p.t, n.t)')} AS t_pass_s, t IS NULL AS is_interpolated FROM (
      SELECT v.vehicle_id, s.station, x.t_depart_s AS t, last_value(CASE WHEN x.t_depart_s IS NOT NULL THEN {{'s': s.station, 't': x.t_depart_s}} END IGNORE NULLS) OVER (PARTITION BY v.vehicle_id ORDER BY s.station ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
      first_value(CASE WHEN x.t_depart_s IS NOT NULL THEN {{'s': s.station, 't': x.t_depart_s}} END IGNORE NULLS) OVER (PARTITION BY v.vehicle_id ORDER BY s.station ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
      FROM (SELECT DISTINCT vehicle_id FROM telemetry) v CROSS JOIN stations s LEFT JOIN telemetry x ON x.vehicle_id = v.vehicle_id AND x.station = s.station)"""),
    "brier": plain(f"SELECT {r('avg((t - 10 * y::INT) * (t - 10 * y::INT)) / 100')} AS brier, count(*) AS n FROM pairs", _Y),
    "reliability": plain(f"SELECT {i('bin')} AS bin, n, {r('mean_p')} AS mean_p, {r('rate')} AS rate, reliable FROM bins", _Y, _BINS),
    "ece": plain(f"SELECT {r('sum(CASE WHEN reliable THEN n * abs(mean_p - rate) END) / sum(CASE WHEN reliable THEN n ELSE 0 END)')} AS ece, {r('sum(CASE WHEN reliable THEN n ELSE 0 END) / sum(n)')} AS coverage FROM bins", _Y, _BINS),
    "confusion": plain(f"SELECT tp, fp, fn, tn, {r('tp / nullif(tp + fp, 0)')} AS precision, {r('tp / nullif(tp + fn, 0)')} AS recall, {r('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1, {r('fp / nullif(fp + tn, 0)')} AS fpr FROM conf", _Y, _C),
    "precision_by_station": plain(f"""SELECT {i('station')} AS station, n, confirmed, {r('p')} AS precision, {r('CASE WHEN n >= 3 THEN greatest(0.5, least(2.0, CASE WHEN p >= 0.5 THEN 1 + (p - 0.5) / 0.5 ELSE 1 - 0.5 * (0.5 - p) / 0.5 END)) ELSE 1.0 END')} AS weight FROM (
      SELECT l_linenumber - 1 AS station, count(*) AS n, count_if(l_returnflag = 'R')::BIGINT AS confirmed, (count_if(l_returnflag = 'R') + 1) / (count(*) + 2)::DOUBLE AS p FROM lineitem WHERE l_quantity >= 48 AND l_returnflag <> 'N' GROUP BY 1)"""),
    "magnitude_bands": plain(f"""SELECT band, count(*) AS n, {r('avg(m)')} AS mean FROM (SELECT round(1 + l_quantity / 50, 4) AS m, CASE WHEN round(1 + l_quantity / 50, 4) <= 1.2 THEN '<=1.20' WHEN round(1 + l_quantity / 50, 4) <= 1.3 THEN '1.20-1.30' WHEN round(1 + l_quantity / 50, 4) <= 1.5 THEN '1.30-1.50' ELSE '>1.50' END AS band FROM lineitem) GROUP BY band"""),
}
