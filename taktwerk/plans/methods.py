"""Queries of the rival methods, all in one contract: window, station, score, detected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import forest as FO
from taktwerk.operators import localise as L
from taktwerk.plans import flow, inference
from taktwerk.plans.base import Query, i, r, sql, tidy
from taktwerk.sources import fixtures as X

FEATURES = ["z_proc", "d_blocked", "d_starved"]
#: Share of the windows that the forests are fitted on; score from which a window counts as detected.
NOMINAL, OUTLIER = 0.4, 0.62
FOREST = FO.ForestSpec()
#: Trees that draw from all nominal windows.
WHOLE = FO.ForestSpec(pool=None)


def isolation_table(spark: SparkSession, sf_dir: str, d: DataFrame | None = None, spec: FO.ForestSpec = FOREST) -> DataFrame:
    """(window, station, score) of the station that is cut off soonest; forests know the first windows only, and the later ones are scored."""
    d = inference.deviations(spark, sf_dir) if d is None else d
    first = F.broadcast(d.agg(F.floor(NOMINAL * (F.max("window") + 1)).alias("fitted")))
    nominal, later = d.crossJoin(first).where("window < fitted").drop("fitted"), d.crossJoin(first).where("window >= fitted").drop("fitted")
    nodes = settled(FO.fit_forest(nominal, "station", "window", FEATURES, spec))
    a = FO.anomaly_scores(later, nodes, "station", "window", FEATURES, spec).withColumn("anomaly", F.round("anomaly", 9))
    return a.groupBy("window").agg(F.max_by("station", F.struct("anomaly", -F.col("station"))).alias("station"), F.max("anomaly").alias("score"))


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most anomalous station of each window after the nominal ones, by a forest a station."""
    return tidy(isolation_table(spark, sf_dir).withColumn("detected", F.col("score") >= OUTLIER))


def all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, window, station, score, detected) of control limits, turning point, forests, observed stations alone and the whole inference."""
    tel = flow.telemetry_table(spark, sf_dir)
    d = inference.deviations(spark, sf_dir, tel)
    scores = inference.scores_of(spark, sf_dir, d)
    limits = flow.spc_of(d).select("window", "station", "score", F.col("flagged").alias("detected"))
    turning = L.turning_point(flow.scored_table(spark, sf_dir, tel)).select("window", "station", F.col("strength").alias("score"), (F.col("strength") >= 0.015).alias("detected"))
    forests = isolation_table(spark, sf_dir, d, WHOLE).withColumn("detected", F.col("score") >= OUTLIER)
    observed = inference.observed_of(scores).select("window", "station", F.col("llr").alias("score"), (F.col("llr") >= 1.0).alias("detected"))
    whole = inference.shadow_of(inference.posterior_of(scores)).select("window", F.col("top_station").alias("station"), F.col("llr").alias("score"), "detected")
    named = {"control_limits": limits, "turning_point": turning, "isolation_forest": forests, "observed_only": observed, "inference": whole}
    rows = [d.select(F.lit(n).alias("method"), "window", F.col("station").cast("long").alias("station"), F.col("score").cast("double").alias("score"), "detected") for n, d in named.items()]
    return tidy(reduce(DataFrame.unionByName, rows))


QUERIES: dict[str, Query] = {f.__name__: f for f in (isolation_forest, all_methods)}

_FEATS = 'feats AS MATERIALIZED (SELECT s."window", s.station, z.z_proc, s.d_blocked, s.d_starved FROM scored s JOIN zs z ON z."window" = s."window" AND z.station = s.station)'
_NOMINAL = f'"window" < floor({NOMINAL} * (SELECT max("window") + 1 FROM feats))'
_FOREST, _WHOLE_FOREST = (FO.forest_sql("feats", _NOMINAL, "station", '"window"', FEATURES, spec) for spec in (FOREST, WHOLE))
_BEST = f"""best AS (SELECT w AS "window", k AS station, a AS score FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY a DESC, k) AS rn FROM (SELECT k, w, round(anomaly, 9) AS a FROM anomalies WHERE w >= floor({NOMINAL} * (SELECT max("window") + 1 FROM feats)))) WHERE rn = 1)"""
_SPC = 'spcs AS (SELECT "window", station, z_proc AS score FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY z_proc DESC, station) AS rn FROM zs) WHERE rn = 1)'
_OBSERVED = f'observed AS (SELECT "window", k AS station, llr AS score FROM (SELECT "window", k, round(llr, 9) AS llr, row_number() OVER (PARTITION BY "window" ORDER BY round(llr, 9) DESC, k) AS rk FROM llrs WHERE k >= 0 AND k <> {X.BLIND}) WHERE rk = 1)'
_WHOLE = """whole AS (SELECT "window", top_station AS station, llr AS score, round(llr, 9) >= 1.0 AND top_prob > p_null AND top_prob > coalesce(p_supply, 0) AND coalesce(abs(lag(top_station) OVER (ORDER BY "window") - top_station) <= 1, false) AS detected FROM (
  SELECT t.*, n.post AS p_null, s.post AS p_supply FROM tops t JOIN post n ON n."window" = t."window" AND n.k = -1 LEFT JOIN post s ON s."window" = t."window" AND s.k = -2))"""

SQL: dict[str, str] = {
    "isolation_forest": sql(f"""SELECT "window", {i('station')} AS station, {r('score')} AS score, score >= {OUTLIER} AS detected FROM best""", *flow._EXP, _FEATS, _FOREST, _BEST),
    "all_methods": sql(f"""SELECT method, "window", {i('station')} AS station, {r('score')} AS score, detected FROM (
      SELECT 'control_limits' AS method, "window", station, score, score >= 3.0 AS detected FROM spcs
      UNION ALL SELECT 'turning_point', "window", station, strength, strength >= 0.015 FROM turns
      UNION ALL SELECT 'isolation_forest', "window", station, score, score >= {OUTLIER} FROM best
      UNION ALL SELECT 'observed_only', "window", station, score, round(score, 6) >= 1.0 FROM observed
      UNION ALL SELECT 'inference', "window", station, score, detected FROM whole)""", *inference._CHAIN, inference._POST, *flow._TURNS, _FEATS, _WHOLE_FOREST, _BEST, _SPC, _OBSERVED, _WHOLE),
}
