"""Evaluation queries: 25 episodes (one a nation) held against the predictions of the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import evaluate as E
from taktwerk.plans import flow, inference
from taktwerk.plans.base import Query, i, plain, r, sql, tidy
from taktwerk.sources import fixtures as X

#: The episodes' columns by nation: expressions that both engines read.
_RULES = {
    "episode": "CAST(n_nationkey AS BIGINT)",
    "seq": "0",
    "kind": "CASE n_nationkey % 4 WHEN 0 THEN 'SLOWDOWN' WHEN 1 THEN 'COMBINED' WHEN 2 THEN 'DEFECT_DRIFT' ELSE 'MATERIAL_DELAY' END",
    "station": "CAST(n_nationkey % 7 AS INTEGER)",
    "t_start_s": "CAST(5000 + 2500 * n_nationkey AS DOUBLE)",
    "t_end_s": "CAST(25000 + 2500 * n_nationkey AS DOUBLE)",
    "ramp_s": "CAST(3000 AS DOUBLE)",
    "magnitude": "1 + (n_nationkey % 6) / CAST(10 AS DOUBLE)",
    "board_moment_s": "CAST(14000 + 2500 * n_nationkey AS DOUBLE)",
}
_EPISODES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RULES.items())


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, seq, kind, station, t_start_s, t_end_s, ramp_s, magnitude, board_moment_s): fixed rules over the nations."""
    return X.table(spark, sf_dir, "nation").select(*[F.expr(e).alias(n) for n, e in _RULES.items()])


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = E.episode_truth(_episodes(spark, sf_dir), X.stations(spark, sf_dir).where("tier = 'MANUAL'"))
    cycles = X.stations(spark, sf_dir).select("station", (F.lit(50.0) + 2 * F.col("station")).alias("base_cycle_s"))
    return E.true_onset(truth, cycles, X.TAKT_S)


def _times(windows: DataFrame) -> DataFrame:
    w = windows.groupBy("window").agg(F.min("t_depart_s_min").alias("t_lo"), F.max("t_depart_s_max").alias("t_hi"))
    return w.withColumn("t_mid_s", (F.col("t_lo") + F.col("t_hi")) / 2)


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window, top_station, detected, t_mid_s): the turning point's detections with the windows' times."""
    w = settled(flow.window_table(spark, sf_dir).select("window", "station", "blocked_s_mean", "starved_s_mean", "t_depart_s_min", "t_depart_s_max"))
    found = flow.detections_of(flow.B.takt_deviation(w, X.TAKT_S)[0])
    return settled(found.select("window", F.col("station").alias("top_station"), "detected").join(_times(w).select("window", "t_mid_s"), "window"))


def window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_times(flow.window_table(spark, sf_dir)).select("window", (F.col("window") * flow.SPEC.stride + flow.SPEC.warmup).alias("v_start"), (F.col("window") * flow.SPEC.stride + flow.SPEC.warmup + flow.SPEC.width).alias("v_end"), "t_lo", "t_hi", "t_mid_s"))


def window_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median time from one window's middle to the next."""
    t = _times(flow.window_table(spark, sf_dir)).select("t_mid_s", "window", F.lit(0).alias("line"))
    return tidy(flow.exact_medians(flow.R.gaps(t, ["line"], "t_mid_s", "window", 7 * 86_400.0), ["line"], "gap", "spacing_s").select("spacing_s", "n"))


def episode_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_truth(spark, sf_dir))


def localisation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.localisation(_pred(spark, sf_dir), _truth(spark, sf_dir)))


def false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.false_alarms(_pred(spark, sf_dir), _truth(spark, sf_dir)))


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _times(flow.window_table(spark, sf_dir)).select("window", "t_mid_s")
    pred = settled(inference.predict_state(spark, sf_dir).join(times, "window"))
    return settled(E.early_warning(pred, _truth(spark, sf_dir)))


def early_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_warnings(spark, sf_dir))


def early_warning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses, false alarms and lead time over the episodes that were not missed."""
    lead = F.when(F.col("missed") == 0, F.col("lead_time_min"))
    d = _warnings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("missed").alias("missed"), F.sum("false_alarm").alias("false_alarms"), F.avg(lead).alias("mean_lead"), F.median(lead).alias("median_lead"), F.min(lead).alias("min_lead"))
    return tidy(d)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_of(_pred(spark, sf_dir), settled(_truth(spark, sf_dir)))


def _scored_of(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return settled(E.localisation(pred, truth).join(truth.select("episode", "kind", "source_is_hidden", "magnitude", "station"), "episode"))


_MEANS = ["detection_rate", "detected_episode", "top1", "within1", "top1_episode", "within1_episode"]


def summarise_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(E.summarise(_scored(spark, sf_dir).select("kind", "episode", "n_windows_during", *_MEANS), ["kind"]))


def experiment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by kind, by hidden source, by both and by magnitude, in one pass."""
    d = E.rolled_up(_scored(spark, sf_dir), [[], ["kind"], ["source_is_hidden"], ["kind", "source_is_hidden"], ["magnitude"]], _MEANS)
    return tidy(d)


def visibility_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of episodes caught, over all, hidden and seen sources."""
    return tidy(E.rolled_up(_scored(spark, sf_dir), [[], ["source_is_hidden"]], ["detected_episode", "within1_episode"]).drop("grain"))


def stress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind, null kept: material delays count as no kind."""
    truth = _truth(spark, sf_dir).select("episode", "kind")
    return tidy(E.false_alarms(_pred(spark, sf_dir), _truth(spark, sf_dir)).join(truth, "episode").groupBy("kind").agg(F.avg("false_alarm_rate").alias("mean_rate"), F.median("false_alarm_rate").alias("median_rate"), F.count(F.lit(1)).alias("n")))


def operating_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-alarm rate and detection rate of each kind, ordered by the first."""
    pred, truth = _pred(spark, sf_dir), settled(_truth(spark, sf_dir))
    fa = E.false_alarms(pred, truth).select("episode", "false_alarm_rate")
    d = _scored_of(pred, truth).join(fa, "episode").groupBy("kind").agg(F.avg("false_alarm_rate").alias("false_alarm_rate"), F.avg("detection_rate").alias("detection_rate"))
    d = d.withColumn("false_alarm_rate", F.round("false_alarm_rate", 9))
    return tidy(d.withColumn("place", F.row_number().over(flow.Window.orderBy("false_alarm_rate", "kind"))))


def cycle_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the hidden station's inferred cycle against what it did, by window."""
    return tidy(_cycle_errors(spark, sf_dir))


def _cycle_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.passes(spark, sf_dir)
    true = flow.W.window_aggregate(p.where(F.col("station") == X.BLIND), flow.SPEC, ["proc_time_s"], flow.W.n_vehicles(X.telemetry(spark, sf_dir))).select("window", F.col("proc_time_s_mean").alias("true_cycle_s"))
    d = inference.hidden_cycle(spark, sf_dir).where("cycle_s IS NOT NULL").join(true.where("true_cycle_s > 0"), "window")
    err = F.abs(F.col("cycle_s") - F.col("true_cycle_s"))
    return d.select("window", F.col("cycle_s").alias("inferred_cycle_s"), "true_cycle_s", err.alias("abs_error_s"), (100 * err / F.col("true_cycle_s")).alias("abs_error_pct"))


def cycle_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and quartiles of the error in per cent."""
    d = settled(_cycle_errors(spark, sf_dir).select(F.round("abs_error_pct", 6).alias("e")))
    q = flow.exact_quantiles(d, [], "e", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return tidy(q.crossJoin(F.broadcast(d.agg(F.avg("e").alias("mean")))), 5)


def separability_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a station's separability with how often it is found, and the least separable station."""
    acc = _scored(spark, sf_dir).groupBy("station").agg(F.avg("within1_episode").alias("accuracy"))
    d = inference.separability(spark, sf_dir).select("station", "separability").join(acc, "station")
    return tidy(d.agg(F.corr("separability", "accuracy").alias("corr"), F.min_by("station", F.struct("separability", "station")).alias("least"), F.count(F.lit(1)).alias("n")))


def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, p) counts: the twin's probability of its top station, and whether the window lies in an episode of a station within one of it."""
    times = _times(flow.window_table(spark, sf_dir)).select("window", "t_mid_s")
    top = inference.top_runner_up(spark, sf_dir).join(times, "window").select("window", "top_station", F.round("top_prob", 1).alias("p"), "t_mid_s")
    hit = top.join(F.broadcast(_truth(spark, sf_dir).where("has_fault").select("station", "t_start_s", "t_end_s")), F.col("t_mid_s").between(F.col("t_start_s"), F.col("t_end_s")) & (F.abs(F.col("top_station") - F.col("station")) <= 1), "left_semi").select("window").distinct().withColumn("y", F.lit(True))
    return tidy(top.join(hit, "window", "left").groupBy(F.coalesce("y", F.lit(False)).alias("y"), "p").agg(F.count(F.lit(1)).alias("n")))


def headline_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle detected window of each named station."""
    return tidy(E.nearest_middle(_pred(spark, sf_dir).where("detected"), ["top_station"], "window", ["t_mid_s"]))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (window_bounds, window_spacing, episode_truth, localisation_metrics, false_alarms, early_warning, early_warning_summary, summarise_by_kind, experiment_rollup, visibility_headline, stress_summary, operating_curve, cycle_error, cycle_error_summary, separability_accuracy, calibration_pairs, headline_alert)
}

_T = 'times AS MATERIALIZED (SELECT "window", min(t_lo) AS t_lo, max(t_hi) AS t_hi, (min(t_lo) + max(t_hi)) / 2 AS t_mid_s FROM wagg GROUP BY "window")'
_WT = f"""(SELECT * FROM ({sql('SELECT * FROM times', _T)}))"""
_TRUTH = f"""episodes AS ({_EPISODES} FROM nation), firsts AS (SELECT * FROM episodes WHERE kind <> 'MATERIAL_DELAY'),
truth AS MATERIALIZED (SELECT *, CASE WHEN ok AND 60 / base <= 1 THEN t_start_s WHEN ok AND (60 / base - 1) / (magnitude - 1) <= 1 THEN t_start_s + (60 / base - 1) / (magnitude - 1) * ramp_s END AS onset_s FROM (
  SELECT e.episode, f.episode IS NOT NULL AS has_fault, f.station, f.kind, f.t_start_s, f.t_end_s, f.ramp_s, f.magnitude, f.board_moment_s, coalesce(f.station = {X.BLIND}, false) AS source_is_hidden, 50.0::DOUBLE + 2 * f.station AS base, coalesce(f.kind IN ('SLOWDOWN', 'COMBINED') AND f.magnitude > 1, false) AS ok
  FROM episodes e LEFT JOIN firsts f USING (episode)))"""
_P = f"""pred AS MATERIALIZED (SELECT d."window", station AS top_station, detected, t_mid_s FROM ({flow.SQL['detection_rule']}) d JOIN {_WT} t ON t."window" = d."window")"""
_LOC = """during AS (SELECT p.*, t.episode, t.station FROM pred p JOIN truth t ON has_fault AND t_mid_s >= t_start_s + 1.0 * ramp_s AND t_mid_s <= t_end_s),
modes AS (SELECT episode, top_station FROM (SELECT episode, top_station, row_number() OVER (PARTITION BY episode ORDER BY count(*) DESC, top_station) AS rk FROM during WHERE detected GROUP BY episode, top_station) WHERE rk = 1),
onsets AS (SELECT t.episode, min(CASE WHEN abs(top_station - station) <= 1 THEN t_mid_s END) AS right_s, min(t_mid_s) AS any_s FROM pred p JOIN truth t ON has_fault AND t_mid_s BETWEEN t_start_s AND t_end_s WHERE detected GROUP BY t.episode),
loc AS MATERIALIZED (SELECT d.episode, n AS n_windows_during, nd / n AS detection_rate, CASE WHEN nd > 0 THEN 1.0::DOUBLE ELSE 0 END AS detected_episode, top1, within1, med AS median_station_error, CASE WHEN nd > 0 AND m.top_station = t.station THEN 1.0::DOUBLE ELSE 0 END AS top1_episode,
  CASE WHEN nd > 0 AND abs(m.top_station - t.station) <= 1 THEN 1.0::DOUBLE ELSE 0 END AS within1_episode, CASE WHEN nd > 0 THEN (t.board_moment_s - o.right_s) / 60 END AS lead_time_min, CASE WHEN nd > 0 THEN o.any_s END AS first_alert_t_s, t.kind, t.source_is_hidden, t.magnitude, t.station
  FROM (SELECT episode, count(*) AS n, count_if(detected) AS nd, avg(CASE WHEN detected THEN (top_station = station)::INT END) AS top1, avg(CASE WHEN detected THEN (abs(top_station - station) <= 1)::INT END) AS within1, median(CASE WHEN detected THEN abs(top_station - station) END) AS med FROM during GROUP BY episode) d
  JOIN truth t ON t.episode = d.episode LEFT JOIN modes m ON m.episode = d.episode LEFT JOIN onsets o ON o.episode = d.episode)"""
_FA = "fa AS MATERIALIZED (SELECT episode, any_value(kind) AS kind, count(*) AS n_quiet_windows, avg(detected::INT) AS false_alarm_rate FROM pred JOIN truth ON NOT has_fault OR t_mid_s < t_start_s OR t_mid_s > t_end_s GROUP BY episode)"
_EW = f"""states AS MATERIALIZED (SELECT s.*, t_mid_s, state IN ('WATCH', 'PREDICTED', 'ACTIVE') AS up FROM ({inference.SQL['predict_state']}) s JOIN {_WT} t ON t."window" = s."window"),
ew AS MATERIALIZED (SELECT episode, (SELECT count(*) FROM states) AS n_windows, CASE WHEN has_fault THEN (right_s IS NULL)::INT::DOUBLE END AS missed, CASE WHEN has_fault THEN 0.0::DOUBLE ELSE ((SELECT count_if(up) FROM states) > 0)::INT::DOUBLE END AS false_alarm,
  CASE WHEN NOT has_fault THEN (SELECT count_if(up) FROM states)::BIGINT END AS n_false_alarm_windows, CASE WHEN has_fault THEN (onset_s - right_s) / 60 END AS lead_time_min, CASE WHEN has_fault THEN (onset_s - any_s) / 60 END AS lead_time_any_min
  FROM truth LEFT JOIN (SELECT e.episode, min(t_mid_s) AS any_s, min(CASE WHEN abs(s.station - e.station) <= 1 THEN t_mid_s END) AS right_s FROM states s JOIN truth e ON has_fault AND t_mid_s >= t_start_s - 3600 AND t_mid_s <= t_end_s WHERE up GROUP BY e.episode) x USING (episode))"""
_CE = f"""errs AS MATERIALIZED (SELECT h."window", h.cycle_s AS inferred_cycle_s, t.c AS true_cycle_s, abs(h.cycle_s - t.c) AS abs_error_s, 100 * abs(h.cycle_s - t.c) / t.c AS abs_error_pct FROM ({inference.SQL['hidden_cycle']}) h JOIN (SELECT w, avg(proc_time_s) AS c FROM (
  SELECT ws."window" AS w, p.proc_time_s FROM (SELECT * FROM ({plain('SELECT vehicle_id, station, proc_time_s FROM passes')})) p JOIN (SELECT * FROM ({sql('SELECT * FROM wins')})) ws ON p.vehicle_id >= ws.v_start AND p.vehicle_id < ws.v_end WHERE p.station = {X.BLIND}) GROUP BY w) t ON t.w = h."window" WHERE h.cycle_s IS NOT NULL AND t.c > 0)"""
_avg = lambda cols: ", ".join(f"{r(f'avg({c})')} AS {c}" for c in cols)


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join(more) + " " + body


SQL: dict[str, str] = {
    "window_bounds": sql(f"""SELECT t."window", v_start, v_end, {r('t_lo')} AS t_lo, {r('t_hi')} AS t_hi, {r('t_mid_s')} AS t_mid_s FROM times t JOIN wins w ON w."window" = t."window\"""", _T),
    "window_spacing": sql(f"""SELECT {r('median(g)')} AS spacing_s, count(g) AS n FROM (SELECT t_mid_s - lag(t_mid_s) OVER (ORDER BY t_mid_s, "window") AS g FROM times)""", _T),
    "episode_truth": _with(f"SELECT episode, has_fault, {i('station')} AS station, kind, t_start_s, t_end_s, ramp_s, {r('magnitude')} AS magnitude, board_moment_s, source_is_hidden, {r('onset_s')} AS onset_s FROM truth", _TRUTH),
    "localisation_metrics": _with(f"SELECT episode, n_windows_during, {', '.join(f'{r(c)} AS {c}' for c in ('detection_rate', 'detected_episode', 'top1', 'within1', 'median_station_error', 'top1_episode', 'within1_episode', 'lead_time_min', 'first_alert_t_s'))} FROM loc", _TRUTH, _P, _LOC),
    "false_alarms": _with(f"SELECT episode, n_quiet_windows, {r('false_alarm_rate')} AS false_alarm_rate FROM fa", _TRUTH, _P, _FA),
    "early_warning": _with(f"SELECT episode, n_windows, missed, false_alarm, n_false_alarm_windows, {r('lead_time_min')} AS lead_time_min, {r('lead_time_any_min')} AS lead_time_any_min FROM ew", _TRUTH, _EW),
    "early_warning_summary": _with(f"SELECT count(*) AS n_episodes, {r('sum(missed)')} AS missed, {r('sum(false_alarm)')} AS false_alarms, {r('avg(l)')} AS mean_lead, {r('median(l)')} AS median_lead, {r('min(l)')} AS min_lead FROM (SELECT *, CASE WHEN missed = 0 THEN lead_time_min END AS l FROM ew)", _TRUTH, _EW),
    "summarise_by_kind": _with(f"SELECT kind, {_avg(['n_windows_during', *_MEANS])}, count(*) AS n_episodes FROM loc GROUP BY kind", _TRUTH, _P, _LOC),
    "experiment_rollup": _with(f"""SELECT kind, {r('magnitude')} AS magnitude, source_is_hidden, CASE WHEN grouping(kind) = 0 THEN 'kind;' ELSE '' END || CASE WHEN grouping(magnitude) = 0 THEN 'magnitude;' ELSE '' END || CASE WHEN grouping(source_is_hidden) = 0 THEN 'source_is_hidden;' ELSE '' END AS grain, {_avg(_MEANS)}, count(*) AS n
      FROM loc GROUP BY GROUPING SETS ((), (kind), (source_is_hidden), (kind, source_is_hidden), (magnitude))""", _TRUTH, _P, _LOC),
    "visibility_headline": _with(f"SELECT source_is_hidden, {_avg(['detected_episode', 'within1_episode'])}, count(*) AS n FROM loc GROUP BY GROUPING SETS ((), (source_is_hidden))", _TRUTH, _P, _LOC),
    "stress_summary": _with(f"SELECT kind, {r('avg(false_alarm_rate)')} AS mean_rate, {r('median(false_alarm_rate)')} AS median_rate, count(*) AS n FROM fa GROUP BY kind", _TRUTH, _P, _FA),
    "operating_curve": _with(f"SELECT *, row_number() OVER (ORDER BY false_alarm_rate, kind) AS place FROM (SELECT loc.kind, {r('avg(fa.false_alarm_rate)')} AS false_alarm_rate, {r('avg(detection_rate)')} AS detection_rate FROM loc JOIN fa USING (episode) GROUP BY loc.kind)", _TRUTH, _P, _LOC, _FA),
    "cycle_error": _with(f"""SELECT "window", {', '.join(f'{r(c)} AS {c}' for c in ('inferred_cycle_s', 'true_cycle_s', 'abs_error_s', 'abs_error_pct'))} FROM errs""", _CE),
    "cycle_error_summary": _with(f"SELECT count(*) AS n, {r('avg(e)', 5)} AS mean, {r('quantile_cont(e, 0.25)', 5)} AS q25, {r('median(e)', 5)} AS q50, {r('quantile_cont(e, 0.75)', 5)} AS q75 FROM (SELECT round(abs_error_pct, 6) AS e FROM errs)", _CE),
    "separability_accuracy": _with(f"SELECT {r('corr(separability, a)')} AS corr, {i('arg_min(station, separability)')} AS least, count(*) AS n FROM (SELECT * FROM ({inference.SQL['separability']})) s JOIN (SELECT station, avg(within1_episode) AS a FROM loc GROUP BY station) USING (station)", _TRUTH, _P, _LOC),
    "calibration_pairs": _with(f"""SELECT EXISTS (SELECT 1 FROM truth e WHERE has_fault AND t_mid_s BETWEEN t_start_s AND t_end_s AND abs(top_station - e.station) <= 1) AS y, round(top_prob, 1) AS p, count(*) AS n FROM ({inference.SQL['top_runner_up']}) x JOIN {_WT} t ON t."window" = x."window" GROUP BY 1, 2""", _TRUTH),
    "headline_alert": _with(f"""SELECT top_station, "window", {r('t_mid_s')} AS t_mid_s FROM (SELECT *, row_number() OVER (PARTITION BY top_station ORDER BY "window") - 1 AS rk, count(*) OVER (PARTITION BY top_station) AS n FROM pred WHERE detected) WHERE rk = n // 2""", _P),
}
