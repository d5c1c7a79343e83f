"""Queries of a frozen context: fitted on the first 40 % of the units, calibrated on the next 20 %, applied to the rest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import baseline as B
from taktwerk.operators import context as C
from taktwerk.operators import localise as L
from taktwerk.operators import windows as W
from taktwerk.plans import flow, inference
from taktwerk.plans.base import SPEC, Query, i, r, sql, tidy
from taktwerk.sources import fixtures as X
from taktwerk.streaming.windows import new_root

FITTED, CALIBRATED = 0.4, 0.6


def _part(spark: SparkSession, sf_dir: str, total: DataFrame) -> DataFrame:
    """``total`` with the units at which the parts end."""
    return total.withColumns({"fit_hi": F.floor(F.col("n_vehicles") * FITTED), "cal_hi": F.floor(F.col("n_vehicles") * CALIBRATED)}).drop("n_vehicles")


def _windows_by_part(windows: DataFrame, ends: DataFrame) -> dict[str, DataFrame]:
    """Windows that lie wholly within a part."""
    lo = SPEC.warmup + SPEC.stride * F.col("window")
    d = windows.crossJoin(F.broadcast(ends)).withColumns({"lo": lo, "hi": lo + SPEC.width})
    parts = {"fit": F.col("hi") <= F.col("fit_hi"), "cal": (F.col("lo") >= F.col("fit_hi")) & (F.col("hi") <= F.col("cal_hi")), "score": F.col("lo") >= F.col("cal_hi")}
    return {name: d.where(c).drop("lo", "hi", "fit_hi", "cal_hi") for name, c in parts.items()}


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[C.Context, DataFrame, DataFrame]:
    """The calibrated context as read back from its tables, the scored windows of the last part, and the calibration's."""
    tel = flow.telemetry_table(spark, sf_dir)
    total = W.n_vehicles(tel)
    ends = _part(spark, sf_dir, total)
    windows = _windows_by_part(settled(W.window_aggregate(tel, SPEC, flow.CHANNELS, total)), ends)
    mix = settled(B.variant_mix(W.in_windows(tel.select("vehicle_id", "variant").distinct(), SPEC, total)))
    shift = settled(B.dominant_shift(W.in_windows(X.vehicles(spark, sf_dir).select("vehicle_id", "shift"), SPEC, total)))
    nominal = tel.crossJoin(F.broadcast(ends)).where("vehicle_id < fit_hi").drop("fit_hi", "cal_hi")
    ctx = C.fit_baseline(windows["fit"], nominal, mix, shift, X.TAKT_S, SPEC)
    root = new_root(spark, "context")
    C.save(ctx, root, "fitted")
    ctx = C.load(spark, root, "fitted", takt_s=X.TAKT_S, spec=SPEC)
    held_out = settled(C.score(ctx, windows["cal"], mix, shift))
    ctx = replace(ctx, tau=C.correlation_share(held_out))
    prop = inference._prop(spark, sf_dir)
    ctx = C.thresholds(ctx, settled(C.posterior(ctx, held_out, prop, X.STATIONS, inference.ALPHA)))
    C.save(ctx, root, "calibrated")
    return C.load(spark, root, "calibrated", takt_s=X.TAKT_S, spec=SPEC), settled(C.score(ctx, windows["score"], mix, shift)), held_out


def fit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, value): what fitting and calibration left, numbers of the line and of each station."""
    ctx, _, _ = _fitted(spark, sf_dir)
    numbers = spark.createDataFrame([(n, v) for n, v in sorted(ctx.numbers().items()) if n not in ("width", "stride", "warmup", "takt_s")], "name string, value double")
    names = [c for c in ctx.stations.columns if c != "station"]
    each = F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit("station"), F.col("station").cast("string"), F.lit(c)).alias("name"), F.col(c).alias("value")) for c in names])).alias("x")
    return tidy(numbers.unionByName(ctx.stations.select(each).select("x.name", "x.value")))


def infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part's windows against the frozen context: leading candidate, its likelihood, whether it is detected or on watch."""
    ctx, scored, _ = _fitted(spark, sf_dir)
    post = settled(C.posterior(ctx, scored, inference._prop(spark, sf_dir), X.STATIONS, inference.ALPHA))
    top = L.top_and_runner_up(post).select("window", "top_station", "top_prob")
    at = post.select("window", F.col("k").alias("top_station"), F.round("llr_s", 9).alias("llr"))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("post"))), F.lit(0.0))
    rivals = post.groupBy("window").agg(pick(L.NULL).alias("p_null"), pick(L.SUPPLY).alias("p_supply"))
    d = top.join(at, ["window", "top_station"]).join(rivals, "window")
    near = F.coalesce(F.abs(F.lag("top_station").over(Window.orderBy("window")) - F.col("top_station")) <= 1, F.lit(False))  # one row a window
    d = d.withColumn("near", near)
    found = (F.col("llr") >= F.round(F.lit(ctx.detect), 9)) & (F.col("top_prob") > F.col("p_null")) & (F.col("top_prob") > F.col("p_supply")) & F.col("near")
    return tidy(d.select("window", "top_station", "top_prob", "llr", "p_null", found.alias("detected"), (F.col("llr") >= F.round(F.lit(ctx.watch), 9)).alias("on_watch")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (fit_context, infer)}

_PARTS = f"""ends AS (SELECT floor(n * {FITTED}) AS fit_hi, floor(n * {CALIBRATED}) AS cal_hi FROM nv),
wpart AS MATERIALIZED (SELECT "window", CASE WHEN v_end <= fit_hi THEN 'fit' WHEN v_start >= fit_hi AND v_end <= cal_hi THEN 'cal' WHEN v_start >= cal_hi THEN 'score' END AS part FROM wins, ends),
tel_fit AS (SELECT telemetry.* FROM telemetry, ends WHERE vehicle_id < fit_hi),
fit_fracs AS (SELECT f.* FROM fracs f JOIN wpart p ON p."window" = f."window" WHERE part = 'fit'),
fc AS (SELECT station, median(blocked_frac) AS bc, median(starved_frac) AS sc FROM fit_fracs GROUP BY station),
fs AS (SELECT f.station, bc, sc, CASE WHEN count(*) < 8 THEN 0.015 ELSE greatest(median(abs(blocked_frac - bc)) * 1.4826, 0.015) END AS bs, CASE WHEN count(*) < 8 THEN 0.015 ELSE greatest(median(abs(starved_frac - sc)) * 1.4826, 0.015) END AS ss FROM fit_fracs f JOIN fc ON fc.station = f.station GROUP BY f.station, bc, sc)"""
_FIT_RESID = """(SELECT q.* FROM resid q JOIN wpart p ON p."window" = q."window" WHERE part = 'fit')"""
_MED = flow._MED.replace("FROM telemetry", "FROM tel_fit").replace("AS n FROM resid GROUP BY station", f"AS n FROM {_FIT_RESID} GROUP BY station").replace("AS scale FROM resid JOIN rc", f"AS scale FROM {_FIT_RESID} resid JOIN rc")
_SCORED = """dev AS MATERIALIZED (SELECT f."window", f.station AS i, round(blocked_frac - bc, 9) AS db, round(starved_frac - sc, 9) AS ds, z.z_proc, part FROM fracs f JOIN fs ON fs.station = f.station JOIN wpart p ON p."window" = f."window" JOIN zs z ON z."window" = f."window" AND z.station = f.station WHERE part IN ('cal', 'score')),
obs AS (SELECT * FROM dev WHERE db IS NOT NULL AND ds IS NOT NULL),
press AS (SELECT "window", i, db - ds AS p FROM dev WHERE part = 'cal'),
steady AS (SELECT i FROM press GROUP BY i HAVING count(p) = (SELECT count(DISTINCT "window") FROM press) AND stddev_samp(p) > 1e-9 * greatest(1.0, abs(avg(p)))),
rhos AS (SELECT a.i, b.i AS j, corr(a.p, b.p) AS rho FROM press a JOIN press b ON a."window" = b."window" AND a.i < b.i WHERE a.i IN (SELECT i FROM steady) AND b.i IN (SELECT i FROM steady) GROUP BY a.i, b.i),
par AS MATERIALIZED (SELECT CASE WHEN (SELECT count(*) FROM steady) < 3 OR (SELECT count(DISTINCT "window") FROM press) < 10 THEN 1.0
  ELSE least(1.0, greatest(1e-3, 1 / (1 + ((SELECT count(*) FROM steady) - 1) * least(0.98, greatest(0.0, (SELECT coalesce(avg(rho), 0) FROM rhos)))))) END::DOUBLE AS tau, (SELECT median(bs) FROM fs) AS sb, (SELECT median(ss) FROM fs) AS s2)"""
_LL = inference._LL.replace(f"{inference.TAU} * -0.5", "(SELECT tau FROM par) * -0.5").replace(f"/ {inference.SIGMA_B ** 2!r}", "/ (SELECT sb * sb FROM par)").replace(f"/ {inference.SIGMA_S ** 2!r}", "/ (SELECT s2 * s2 FROM par)")
_LL = _LL.replace('row_number() OVER (PARTITION BY a.k ORDER BY a."window") AS rn FROM lls a', 'row_number() OVER (PARTITION BY part, a.k ORDER BY a."window") AS rn, part FROM lls a JOIN wpart wp ON wp."window" = a."window"')
_POST = inference._POST.replace('SELECT "window", k, rn, llr, llr AS y FROM llrs', 'SELECT "window", k, rn, llr, llr AS y, part FROM llrs').replace("* s.y FROM smooth s JOIN llrs l ON l.k = s.k", "* s.y, l.part FROM smooth s JOIN llrs l ON l.part = s.part AND l.k = s.k")
_THRESH = """lead AS (SELECT t."window", round(t.llr, 9) AS v FROM tops t JOIN wpart p ON p."window" = t."window" WHERE part = 'cal'),
cuts0 AS (SELECT greatest(coalesce(quantile_cont(v, 0.99), 8.0), 1.0) AS detect, quantile_cont(v, 0.95) AS w, stddev_pop(v) AS noise FROM lead),
cuts1 AS MATERIALIZED (SELECT detect, least(greatest(least(w, 0.9 * detect), 0.25), detect) AS watch, noise FROM cuts0)"""
_FROZEN = (flow._MIX, flow._SHIFT, _PARTS, _MED, inference._P, inference._PROP, _SCORED, _LL, _POST, _THRESH)
_STATION = " UNION ALL ".join(f"SELECT concat('station_', rs.station, '_{n}'), {e} FROM rs JOIN fs ON fs.station = rs.station" for n, e in (("proc_center", "center"), ("proc_scale", "scale"), ("blocked_center", "bc"), ("blocked_scale", "bs"), ("starved_center", "sc"), ("starved_scale", "ss")))

SQL: dict[str, str] = {
    "fit_context": sql(f"""SELECT name, {r('value')} AS value FROM (SELECT 'tau' AS name, tau AS value FROM par UNION ALL SELECT 'sigma_blocked', sb FROM par UNION ALL SELECT 'sigma_starved', s2 FROM par
      UNION ALL SELECT 'detect', detect FROM cuts1 UNION ALL SELECT 'watch', watch FROM cuts1 UNION ALL SELECT 'noise', noise FROM cuts1 UNION ALL {_STATION})""", *_FROZEN),
    "infer": sql(f"""SELECT "window", {i('top_station')} AS top_station, {r('top_prob')} AS top_prob, {r('llr')} AS llr, {r('p_null')} AS p_null, llr >= round(detect, 9) AND top_prob > p_null AND top_prob > p_supply AND near AS detected, llr >= round(watch, 9) AS on_watch FROM (
      SELECT t."window", top_station, top_prob, round(t.llr, 9) AS llr, n.post AS p_null, coalesce(s.post, 0) AS p_supply, coalesce(abs(lag(top_station) OVER (ORDER BY t."window") - top_station) <= 1, false) AS near FROM tops t JOIN wpart p ON p."window" = t."window" AND part = 'score'
      JOIN post n ON n."window" = t."window" AND n.k = -1 LEFT JOIN post s ON s."window" = t."window" AND s.k = -2), cuts1""", *_FROZEN),
}
