"""Inference queries: the graph, likelihoods, posteriors, states and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import localise as L
from taktwerk.operators import runs as R
from taktwerk.operators import topology as T
from taktwerk.operators import windows as W
from taktwerk.plans import flow
from taktwerk.plans.base import SPEC, Query, i, plain, r, sql, tidy
from taktwerk.sources import fixtures as X

SIGMA_B, SIGMA_S, TAU, ALPHA = 0.03, 0.05, 0.5, 0.55


def buffer_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.serial_distance(X.stations(spark, sf_dir)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain and a bypass from station 1 to 4."""
    return settled(T.chain_edges(settled(X.stations(spark, sf_dir)))).union(spark.createDataFrame([(1, 4, 3)], "src int, dst int, buffer_capacity long"))


def graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.graph_distance(spark, settled(X.stations(spark, sf_dir)), _edges(spark, sf_dir)))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.reachable(spark, _edges(spark, sf_dir)))


def topological_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.topological_depth(spark, settled(X.stations(spark, sf_dir)), _edges(spark, sf_dir)))


def zone_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.zone_bounds(X.stations(spark, sf_dir)))


def nearest_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(T.nearest_observed(X.stations(spark, sf_dir), 2))


def _prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most stations x stations rows: worked out once, then a local table that every use broadcasts."""
    st = settled(X.stations(spark, sf_dir))
    prop = T.propagation(T.serial_distance(st), T.reachable(spark, T.chain_edges(st)))
    return spark.createDataFrame(prop.collect(), prop.schema)


def propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_prop(spark, sf_dir), 9)


def score_table(spark: SparkSession, sf_dir: str, tel: DataFrame | None = None) -> DataFrame:
    return scores_of(spark, sf_dir, deviations(spark, sf_dir, tel))


def deviations(spark: SparkSession, sf_dir: str, tel: DataFrame | None = None) -> DataFrame:
    """(window, station, d_blocked, d_starved, z_proc), settled."""
    # Every hypothesis starts from the scored windows, and the posterior uses the scores several times: both are computed once.
    tel = flow.telemetry_table(spark, sf_dir) if tel is None else tel
    means = flow.mean_table(spark, sf_dir, tel)
    scored = flow.B.takt_deviation(means, X.TAKT_S)[0].join(flow.z_table(spark, sf_dir, tel, means).select("window", "station", "z_proc"), ["window", "station"])
    return settled(scored.select("window", "station", "d_blocked", "d_starved", "z_proc"))


def scores_of(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    """The likelihoods from deviations that are already at hand."""
    return settled(L.llr(L.hypothesis_scores(scored, _prop(spark, sf_dir), SIGMA_B, SIGMA_S, TAU)).select("window", "k", "llr"))


def hypothesis_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(score_table(spark, sf_dir).select("window", "k", "llr"))


def observed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely of the stations that have sensors."""
    return observed_of(score_table(spark, sf_dir))


def observed_of(scores: DataFrame) -> DataFrame:
    """``observed_only`` from likelihoods that are already at hand."""
    s = scores.where((F.col("k") >= 0) & (F.col("k") != X.BLIND)).withColumn("llr", F.round("llr", 9))
    return tidy(s.groupBy("window").agg(F.max_by("k", F.struct("llr", -F.col("k"))).alias("station"), F.max("llr").alias("llr")))


def posterior_table(spark: SparkSession, sf_dir: str, tel: DataFrame | None = None) -> DataFrame:
    return posterior_of(score_table(spark, sf_dir, tel))


def posterior_of(s: DataFrame) -> DataFrame:
    """The posterior from likelihoods that are already at hand."""
    smooth = R.ewma(s.where("k >= 0").select("window", "k", "llr"), ["k"], "window", "llr", "llr_s", ALPHA)
    rest = s.where("k < 0").select("window", "k", "llr", F.col("llr").alias("llr_s"))
    return settled(L.posterior(smooth.unionByName(rest), X.STATIONS))


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(posterior_table(spark, sf_dir).select("window", "k", "post"))


def top_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.top_and_runner_up(posterior_table(spark, sf_dir)))


def candidate_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.candidate_group(posterior_table(spark, sf_dir)))


def shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a window: top, mass of its group, whether it is hidden, persists, is detected and is confident."""
    return shadow_of(posterior_table(spark, sf_dir))


def shadow_of(post: DataFrame) -> DataFrame:
    """``shadow`` from a posterior that is already at hand."""
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("post")))
    p = post.groupBy("window").agg(pick(L.NULL).alias("p_null"), pick(L.SUPPLY).alias("p_line_supply"))
    at = post.select("window", F.col("k").alias("top_station"), F.col("llr_s").alias("llr"))
    d = L.candidate_group(post).join(L.top_and_runner_up(post).select("window", "top_prob"), "window").join(at, ["window", "top_station"]).join(p, "window")
    near = F.coalesce(F.abs(F.lag("top_station").over(Window.orderBy("window")) - F.col("top_station")) <= 1, F.lit(False))
    d = d.withColumn("persistent", near)
    found = (F.round("llr", 9) >= 1.0) & (F.col("top_prob") > F.col("p_null")) & (F.col("top_prob") > F.coalesce("p_line_supply", F.lit(0.0))) & F.col("persistent")
    d = d.withColumn("detected", found)
    return tidy(d.select("window", "top_station", "top_prob", "group_prob", "llr", "p_null", (F.col("top_station") == X.BLIND).alias("top_is_hidden"), "detected", (F.col("detected") & (F.round("group_prob", 9) >= 0.45)).alias("confident")))


def hidden_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle of the blind station in each window: gaps of departures, in build order, at the first observed station after it, those within the 5th to 85th percentile."""
    return tidy(hidden_cycle_table(spark, sf_dir))


def hidden_cycle_table(spark: SparkSession, sf_dir: str, tel: DataFrame | None = None) -> DataFrame:
    tel = X.telemetry(spark, sf_dir) if tel is None else tel
    d = W.in_windows(tel.where(F.col("station") == X.BLIND + 1).select("vehicle_id", "t_depart_s"), SPEC, W.n_vehicles(tel))
    build = Window.partitionBy("window").orderBy("vehicle_id")
    d = d.withColumns({"gap": F.col("t_depart_s") - F.lag("t_depart_s").over(build), "rows": F.count(F.lit(1)).over(Window.partitionBy("window"))}).where("gap > 0 AND rows >= 4")
    cut = d.groupBy("window").agg(F.expr("percentile(gap, array(0.05, 0.85))").alias("p"), F.count(F.lit(1)).alias("n_gaps"), F.avg("gap").alias("plain"))
    inside = d.join(cut, "window").where("gap BETWEEN round(p[0], 9) AND round(p[1], 9)").groupBy("window").agg(F.avg("gap").alias("trimmed"))
    out = cut.join(inside, "window", "left")
    return out.select("window", "n_gaps", F.when(F.col("n_gaps") >= 3, F.coalesce("trimmed", "plain")).alias("cycle_s"))


def forecast(d: DataFrame) -> DataFrame:
    """``d`` (cycle_s) with what the cycle costs over the next hour: binding, loss, units_lost, minutes until the next station starves and the one before blocks.

    Without a cycle there is no forecast: all are null."""
    p, takt, half = F.col("cycle_s"), X.TAKT_S, X.BUFFER / 2.0
    d = d.withColumn("binding", F.round(p, 9) > takt)
    deficit = F.when(F.col("binding"), 1 / takt - 1 / p)
    known = lambda c: F.when(p.isNotNull(), c)
    return d.withColumns({
        "loss": known(F.when(F.col("binding"), 1 - takt / p).otherwise(0.0)), "units_lost": known(F.coalesce(deficit, F.lit(0.0)) * 3600),
        "minutes_to_starve": half / deficit / 60, "minutes_to_block": (X.BUFFER - half) / deficit / 60,
    })


def candidate_cycle(spark: SparkSession, sf_dir: str, tops: DataFrame, tel: DataFrame | None = None) -> DataFrame:
    """``tops`` (window, top_station) with the leading candidate's own ``cycle_s``: the window's mean where it has sensors, else from the departures after it."""
    tel = flow.telemetry_table(spark, sf_dir) if tel is None else tel
    seen = flow.window_table(spark, sf_dir, tel).select("window", F.col("station").cast("long").alias("top_station"), F.col("proc_time_s_mean").alias("seen_s"))
    hidden = hidden_cycle_table(spark, sf_dir, tel).select("window", F.lit(X.BLIND).cast("long").alias("top_station"), F.col("cycle_s").alias("hidden_s"))
    d = tops.withColumn("top_station", F.col("top_station").cast("long")).join(seen, ["window", "top_station"], "left").join(hidden, ["window", "top_station"], "left")
    return d.withColumn("cycle_s", F.when(F.col("top_station") == X.BLIND, F.col("hidden_s")).otherwise(F.col("seen_s"))).drop("seen_s", "hidden_s")


def ripple_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hidden station's cycle costs over the next hour."""
    d = forecast(hidden_cycle_table(spark, sf_dir).where("cycle_s IS NOT NULL"))
    return tidy(d.select("window", "cycle_s", "binding", "loss", "units_lost", "minutes_to_starve", "minutes_to_block"), 4)


def predict_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each station by window."""
    d = flow.scored_table(spark, sf_dir).select("window", "station", (F.round((F.col("d_blocked") - F.col("d_starved")) * 100, 6)).alias("x"), "proc_time_s_mean")
    d = R.ewma(d, ["station"], "window", "x", "llr", ALPHA)
    d = R.trailing_slope(d, ["station"], "window", "llr", "slope", 5, 3)
    d = d.select("window", "station", F.round("llr", 6).alias("llr"), F.round("slope", 6).alias("slope"), (F.col("x") > 0).alias("confident"), F.col("proc_time_s_mean").alias("cycle_s"), F.lit(26.0).alias("takt_s"))
    return tidy(R.predict_states(d, ["station"], "window", detect=1.0, watch=0.5, rising=0.15).select("window", "station", "state"))


def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each station's response stands apart from its most similar rival's."""
    return tidy(separability_table(spark, sf_dir))


def separability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = X.stations(spark, sf_dir).where("tier <> 'MANUAL'").select(F.col("station").alias("i"))
    p = _prop(spark, sf_dir).join(F.broadcast(seen), "i").select("k", "i", (F.col("b") / SIGMA_B).alias("x"), (F.col("s") / SIGMA_S).alias("y"))
    norm = p.groupBy("k").agg(F.sqrt(F.sum(F.col("x") ** 2 + F.col("y") ** 2)).alias("norm"))
    pairs = p.alias("a").join(p.alias("b"), F.col("a.i") == F.col("b.i")).where("a.k <> b.k").groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("rival")).agg(F.sum(F.col("a.x") * F.col("b.x") + F.col("a.y") * F.col("b.y")).alias("dot"))
    c = pairs.join(norm, "k").join(norm.select(F.col("k").alias("rival"), F.col("norm").alias("rn")), "rival").where("norm > 1e-12 AND rn > 1e-12")
    c = c.withColumn("cos", F.round(F.col("dot") / (F.col("norm") * F.col("rn")), 9))
    g = c.groupBy("k", "norm").agg(F.max("cos").alias("ambiguity"), F.max_by("rival", F.struct("cos", -F.col("rival"))).alias("confusable_with"))
    sep = F.col("norm") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("ambiguity") * F.col("ambiguity")))
    return g.select(F.col("k").alias("station"), "ambiguity", "confusable_with", sep.alias("separability"))


def bottleneck_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and share of them of every station's turning point, and the suspicion weight that follows."""
    n = L.turning_point(flow.scored_table(spark, sf_dir)).groupBy("station").agg(F.count(F.lit(1)).alias("n"))
    d = X.stations(spark, sf_dir).select("station").join(n, "station", "left").select("station", F.coalesce("n", F.lit(0)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return tidy(d.withColumn("share", share).withColumn("suspicion", 0.25 + 0.75 * F.col("share")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (buffer_distance, graph_distance, reachability, topological_depth, zone_bounds, nearest_observed, propagation, hypothesis_llr, observed_only, posterior, top_runner_up, candidate_group, shadow, hidden_cycle, ripple_forecast, predict_state, separability, bottleneck_frequency)
}

_P = "pos AS (SELECT station, coalesce(sum(out_buffer) OVER (ORDER BY station ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM stations)"
_PROP = "prop AS (SELECT a.station AS k, b.station AS i, abs(b.p - a.p)::DOUBLE AS dist, CASE WHEN b.station < a.station THEN exp(-abs(b.p - a.p) / 9.0::DOUBLE) ELSE 0 END AS b, CASE WHEN b.station > a.station THEN exp(-abs(b.p - a.p) / 16.0::DOUBLE) ELSE 0 END AS s FROM pos a, pos b)"
_E = f"edges AS (SELECT station AS src, station + 1 AS dst, out_buffer AS cap FROM stations WHERE station < {X.STATIONS - 1} UNION ALL SELECT 1, 4, 3)"
_WALK = "reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"
_OBS = 'obs AS (SELECT s."window", s.station AS i, d_blocked AS db, d_starved AS ds, z.z_proc FROM scored s JOIN zs z ON z."window" = s."window" AND z.station = s.station)'
_LL = f"""sums AS (SELECT "window", k, sum(b * db) AS bd, sum(b * b) AS bb, sum(s * ds) AS sd, sum(s * s) AS ss, sum(db * db) AS qb, sum(ds * ds) AS qs, count(*) AS n, max(CASE WHEN o.i = k THEN z_proc END) AS z FROM obs o JOIN prop p ON p.i = o.i GROUP BY "window", k),
amps AS (SELECT *, CASE WHEN bb > 1e-12 THEN greatest(0, bd / bb) ELSE 0 END AS ab, CASE WHEN ss > 1e-12 THEN greatest(0, sd / ss) ELSE 0 END AS a FROM sums WHERE n >= 4),
zero AS (SELECT o."window", sum(db * db) AS qb, sum(ds * ds) AS qs, sum(exp(-p.dist / 16.0::DOUBLE) * ds) AS pd, sum(exp(-p.dist / 16.0::DOUBLE) * exp(-p.dist / 16.0::DOUBLE)) AS pp, count(*) AS n FROM obs o JOIN prop p ON p.k = 0 AND p.i = o.i GROUP BY o."window"),
lls AS MATERIALIZED (SELECT "window", k, {TAU} * -0.5 * ((qb - 2 * ab * bd + ab * ab * bb) / {SIGMA_B ** 2!r} + (qs - 2 * a * sd + a * a * ss) / {SIGMA_S ** 2!r}) + CASE WHEN z IS NULL THEN 0 ELSE -0.5 * ((z - 3.5) / 3.0) ** 2 - ln(3.0::DOUBLE) + 0.5 * z * z END AS ll FROM amps
  UNION ALL SELECT "window", -1, CASE WHEN n >= 4 THEN {TAU} * -0.5 * (qb / {SIGMA_B ** 2!r} + qs / {SIGMA_S ** 2!r}) ELSE 0 END FROM zero
  UNION ALL SELECT "window", -2, {TAU} * -0.5 * (qb / {SIGMA_B ** 2!r} + (qs - 2 * greatest(0, pd / pp) * pd + greatest(0, pd / pp) ** 2 * pp) / {SIGMA_S ** 2!r}) FROM zero WHERE n >= 4),
llrs AS MATERIALIZED (SELECT a."window", a.k, a.ll - b.ll AS llr, row_number() OVER (PARTITION BY a.k ORDER BY a."window") AS rn FROM lls a JOIN lls b ON b."window" = a."window" AND b.k = -1)"""
_POST = f"""smooth AS (SELECT "window", k, rn, llr, llr AS y FROM llrs WHERE rn = 1 AND k >= 0 UNION ALL SELECT l."window", l.k, l.rn, l.llr, {ALPHA}::DOUBLE * l.llr + {1 - ALPHA}::DOUBLE * s.y FROM smooth s JOIN llrs l ON l.k = s.k AND l.rn = s.rn + 1),
logits AS (SELECT "window", k, y, y + ln(0.1::DOUBLE / {X.STATIONS + 1}) AS g FROM smooth UNION ALL SELECT "window", k, llr, llr + CASE WHEN k = -1 THEN ln(0.9::DOUBLE) ELSE ln(0.1::DOUBLE / {X.STATIONS + 1}) END FROM llrs WHERE k < 0),
post AS MATERIALIZED (SELECT "window", k, y, exp(g - max(g) OVER w) / sum(exp(g - m)) OVER w AS post FROM (SELECT *, max(g) OVER (PARTITION BY "window") AS m FROM logits) WINDOW w AS (PARTITION BY "window")),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY round(post, 9) DESC, k) AS rk FROM post WHERE k >= 0),
tops AS MATERIALIZED (SELECT a."window", a.k AS top_station, a.post AS top_prob, a.y AS llr, b.k AS r_station, b.post AS r_prob FROM ranked a JOIN ranked b ON a."window" = b."window" AND a.rk = 1 AND b.rk = 2),
grp AS (SELECT t."window", top_station, (SELECT coalesce(max(k), -1) + 1 FROM post p WHERE p."window" = t."window" AND k >= 0 AND k < top_station AND round(post, 9) < round(0.25 * top_prob, 9)) AS lo,
  (SELECT coalesce(min(k), {X.STATIONS}) - 1 FROM post p WHERE p."window" = t."window" AND k > top_station AND round(post, 9) < round(0.25 * top_prob, 9)) AS hi FROM tops t),
groups AS (SELECT g.*, (SELECT sum(post) FROM post p WHERE p."window" = g."window" AND k BETWEEN lo AND hi) AS mass FROM grp g)"""
_CHAIN = (*flow._EXP, _P, _PROP, _OBS, _LL)
_GAPS = """gaps AS (SELECT * FROM (SELECT "window", t_depart_s - lag(t_depart_s) OVER (PARTITION BY "window" ORDER BY vehicle_id) AS gap, count(*) OVER (PARTITION BY "window") AS n_rows FROM tw WHERE station = 4) WHERE gap > 0 AND n_rows >= 4),
cuts AS (SELECT "window", quantile_cont(gap, 0.05) AS p5, quantile_cont(gap, 0.85) AS p85, count(*) AS n, avg(gap) AS plain FROM gaps GROUP BY "window"),
cycles AS (SELECT c."window", c.n, CASE WHEN c.n >= 3 THEN coalesce(avg(gap), any_value(plain)) END AS cycle_s FROM cuts c LEFT JOIN gaps g ON g."window" = c."window" AND gap BETWEEN round(p5, 9) AND round(p85, 9) GROUP BY c."window", c.n)"""
_STATES = """xs AS MATERIALIZED (SELECT "window", station, round((d_blocked - d_starved) * 100, 6) AS x, proc_time_s_mean AS cycle_s, row_number() OVER (PARTITION BY station ORDER BY "window") AS rn FROM scored),
sm AS (SELECT *, x AS y FROM xs WHERE rn = 1 UNION ALL SELECT o.*, 0.55::DOUBLE * o.x + 0.45::DOUBLE * p.y FROM sm p JOIN xs o ON o.station = p.station AND o.rn = p.rn + 1),
sl AS (SELECT *, round(y, 6) AS llr, round(CASE WHEN count(*) OVER f >= 3 THEN coalesce(regr_slope(y, rn) OVER f, 0) ELSE 0 END, 6) AS slope FROM sm WINDOW f AS (PARTITION BY station ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
bs AS MATERIALIZED (SELECT *, CASE WHEN x > 0 AND llr >= 1.0 AND cycle_s > 26 THEN 'ACTIVE' WHEN x > 0 AND llr >= 1.0 THEN 'PREDICTED' WHEN llr >= 0.5 THEN 'WATCH' WHEN slope > 0.15 THEN 'DEGRADING' END AS base FROM sl),
st AS (SELECT "window", station, rn, coalesce(base, 'NORMAL') AS state FROM bs WHERE rn = 1
  UNION ALL SELECT b."window", b.station, b.rn, coalesce(b.base, CASE WHEN s.state IN ('WATCH', 'PREDICTED', 'ACTIVE') AND b.slope < -0.15 THEN 'RECOVERING' WHEN s.state = 'RECOVERING' AND b.slope <= 0 THEN 'RECOVERING' ELSE 'NORMAL' END) FROM st s JOIN bs b ON b.station = s.station AND b.rn = s.rn + 1)"""
_RESP = f"""resp AS (SELECT k, i, b / {SIGMA_B} AS x, s / {SIGMA_S} AS y FROM prop WHERE i <> {X.BLIND}), nrm AS (SELECT k, sqrt(sum(x * x + y * y)) AS n FROM resp GROUP BY k),
cs AS (SELECT a.k, b.k AS rival, round(sum(a.x * b.x + a.y * b.y) / (any_value(na.n) * any_value(nb.n)), 9) AS c, any_value(na.n) AS n FROM resp a JOIN resp b ON a.i = b.i AND a.k <> b.k JOIN nrm na ON na.k = a.k JOIN nrm nb ON nb.k = b.k WHERE na.n > 1e-12 AND nb.n > 1e-12 GROUP BY a.k, b.k)"""

SQL: dict[str, str] = {
    "buffer_distance": plain(f"SELECT {i('a.station')} AS k, {i('b.station')} AS i, {r('abs(b.p - a.p)')} AS dist FROM pos a, pos b", _P),
    "graph_distance": plain(f"SELECT {i('k')} AS k, {i('i')} AS i, {r('min(d)')} AS dist FROM walk GROUP BY k, i", _E,
      "both_ways AS (SELECT src, dst, cap FROM edges UNION ALL SELECT dst, src, cap FROM edges)", f"walk AS (SELECT station AS k, station AS i, 0::BIGINT AS d, 0 AS steps FROM stations UNION ALL SELECT k, dst, d + cap, steps + 1 FROM walk JOIN both_ways ON i = src WHERE steps < {X.STATIONS - 1})"),
    "reachability": plain(f"SELECT {i('src')} AS src, {i('dst')} AS dst FROM reach", _E, _WALK),
    "topological_depth": plain(f"SELECT {i('station')} AS station, {i('max(depth)')} AS depth FROM deep GROUP BY station", _E, "deep AS (SELECT station, 0 AS depth FROM stations UNION ALL SELECT dst, depth + 1 FROM deep JOIN edges ON src = station)"),
    "zone_bounds": plain(f"SELECT zone, {i('min(station)')} AS first, {i('max(station)')} AS last, {i('count_if(tier = $$RICH$$)')} AS rich, {i('count_if(tier = $$BASIC$$)')} AS basic, {i('count_if(tier = $$MANUAL$$)')} AS manual FROM stations GROUP BY zone"),
    "nearest_observed": plain(f"""SELECT {i('station')} AS station, side, {i('observed')} AS observed, rank FROM (SELECT s.station, CASE WHEN o.station < s.station THEN 'up' ELSE 'down' END AS side, o.station AS observed,
      row_number() OVER (PARTITION BY s.station, o.station < s.station ORDER BY abs(o.station - s.station)) AS rank FROM stations s JOIN stations o ON o.station <> s.station AND o.tier <> 'MANUAL') WHERE rank <= 2"""),
    "propagation": plain(f"SELECT {i('k')} AS k, {i('i')} AS i, {r('dist', 9)} AS dist, {r('b', 9)} AS b, {r('s', 9)} AS s FROM prop", _P, _PROP),
    "hypothesis_llr": sql(f"""SELECT "window", {i('k')} AS k, {r('llr')} AS llr FROM llrs""", *_CHAIN),
    "observed_only": sql(f"""SELECT "window", {i('k')} AS station, {r('llr')} AS llr FROM (SELECT "window", k, round(llr, 9) AS llr, row_number() OVER (PARTITION BY "window" ORDER BY round(llr, 9) DESC, k) AS rk FROM llrs WHERE k >= 0 AND k <> {X.BLIND}) WHERE rk = 1""", *_CHAIN),
    "posterior": sql(f"""SELECT "window", {i('k')} AS k, {r('post')} AS post FROM post""", *_CHAIN, _POST),
    "top_runner_up": sql(f"""SELECT "window", {i('top_station')} AS top_station, {r('top_prob')} AS top_prob, {i('r_station')} AS runner_up_station, {r('r_prob')} AS runner_up_prob FROM tops""", *_CHAIN, _POST),
    "candidate_group": sql(f"""SELECT "window", {i('top_station')} AS top_station, {i('lo')} AS group_lo, {i('hi')} AS group_hi, {r('mass')} AS group_prob FROM groups""", *_CHAIN, _POST),
    "shadow": sql(f"""SELECT "window", {i('top_station')} AS top_station, {r('top_prob')} AS top_prob, {r('mass')} AS group_prob, {r('llr')} AS llr, {r('p_null')} AS p_null, top_station = {X.BLIND} AS top_is_hidden, det AS detected, det AND round(mass, 9) >= 0.45 AS confident FROM (
      SELECT *, round(llr, 9) >= 1.0 AND top_prob > p_null AND top_prob > coalesce(p_supply, 0) AND coalesce(abs(lag(top_station) OVER (ORDER BY "window") - top_station) <= 1, false) AS det FROM (
      SELECT t.*, g.mass, n.post AS p_null, s.post AS p_supply FROM tops t JOIN groups g ON g."window" = t."window" JOIN post n ON n."window" = t."window" AND n.k = -1 LEFT JOIN post s ON s."window" = t."window" AND s.k = -2))""", *_CHAIN, _POST),
    "hidden_cycle": sql(f"""SELECT "window", n AS n_gaps, {r('cycle_s')} AS cycle_s FROM cycles""", _GAPS),
    "ripple_forecast": sql(f"""SELECT "window", {r('cycle_s', 4)} AS cycle_s, b AS binding, {r('CASE WHEN b THEN 1 - 60.0::DOUBLE / cycle_s ELSE 0 END', 4)} AS loss, {r('coalesce(d, 0) * 3600', 4)} AS units_lost, {r('1.0::DOUBLE / d / 60', 4)} AS minutes_to_starve, {r('1.0::DOUBLE / d / 60', 4)} AS minutes_to_block
      FROM (SELECT *, round(cycle_s, 9) > 60 AS b, CASE WHEN round(cycle_s, 9) > 60 THEN 1 / 60.0::DOUBLE - 1 / cycle_s END AS d FROM cycles WHERE cycle_s IS NOT NULL)""", _GAPS),
    "predict_state": sql(f"""SELECT "window", {i('station')} AS station, state FROM st""", _STATES),
    "separability": plain(f"""SELECT {i('k')} AS station, {r('c')} AS ambiguity, {i('rival')} AS confusable_with, {r('n * sqrt(greatest(0, 1 - c * c))')} AS separability FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, rival) AS rk FROM cs) WHERE rk = 1""", _P, _PROP, _RESP),
    "bottleneck_frequency": sql(f"""SELECT {i('station')} AS station, n, {r('n / sum(n) OVER ()')} AS share, {r('0.25 + 0.75 * n / sum(n) OVER ()')} AS suspicion FROM (SELECT s.station, count(t.station) AS n FROM stations s LEFT JOIN turns t ON t.station = s.station GROUP BY s.station)""", *flow._TURNS),
}
