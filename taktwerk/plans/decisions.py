"""Decision queries: recommendations, jobs, waiting cost, ledger, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import decide as D
from taktwerk.operators import runs as R
from taktwerk.operators.ledger import GENESIS
from taktwerk.plans import flow, inference
from taktwerk.plans.base import Query, i, plain, r, sql, tidy
from taktwerk.sources import fixtures as X



def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recommendation rests on, of every window: posterior, candidate group, blocking before it, the leading candidate's own forecast, and whether it is detected."""
    tel = flow.telemetry_table(spark, sf_dir)
    post = inference.posterior_table(spark, sf_dir, tel)
    group = tidy(inference.L.candidate_group(post))
    top = tidy(inference.L.top_and_runner_up(post)).select("window", "top_prob")
    supply = tidy(post.where(F.col("k") == inference.L.SUPPLY).select("window", F.col("post").alias("p_supply")))
    cycles = tidy(inference.candidate_cycle(spark, sf_dir, group.select("window", "top_station"), tel), 4)
    forecast = tidy(inference.forecast(cycles).select("window", "cycle_s", "binding", "units_lost"), 4)
    found = inference.shadow_of(post).select("window", "detected")
    dev = tidy(flow.scored_table(spark, sf_dir, tel).select("window", "station", "d_blocked"))
    near = spark.createDataFrame([(s, o) for s in range(X.STATIONS) for o in [o for o in range(s) if o != X.BLIND][-3:]], "top_station long, station long")
    before = dev.join(F.broadcast(near), "station").groupBy("window", "top_station").agg(F.max("d_blocked").alias("upstream_blocked"))
    d = group.join(top, "window").join(supply, "window", "left").join(forecast, "window", "left").join(found, "window", "left").join(before, ["window", "top_station"], "left")
    d = d.withColumns({"p_supply": F.coalesce("p_supply", F.lit(0.0)), "group_size": (F.col("group_hi") - F.col("group_lo") + 1).cast("int"), "confident": F.col("group_prob") >= 0.45})
    return settled(d.select("window", "top_station", "top_prob", "group_prob", "group_size", "confident", "p_supply", "upstream_blocked", "cycle_s", "binding", "units_lost", F.coalesce("detected", F.lit(False)).alias("detected")))


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.flow_recommendation(alert_table(spark, sf_dir))


def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_recommended(spark, sf_dir).select("window", "top_station", "action", "priority", "abstained", "n_targets", "taxonomy"))


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.work_orders(_recommended(spark, sf_dir)).select("window", "action", "owner", "respond_min", "escalate_min", "escalate_to", "verify"))


def work_order_raise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first detected window that fired for each station that a job names."""
    d = D.work_orders(_recommended(spark, sf_dir).where("detected"))
    return tidy(d.groupBy("top_station").agg(F.min("window").alias("window"), F.min_by("action", "window").alias("action"), F.count(F.lit(1)).alias("n_windows")))


def waiting_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inference.ripple_forecast(spark, sf_dir).select("window", "binding", "units_lost")
    return tidy(D.waiting_cost(f), 4)


def alert_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle, forecast, recommendation and job of every detected window in one row."""
    rec = settled(D.waiting_cost(_recommended(spark, sf_dir).where("detected")))
    jobs = D.work_orders(rec).select("window", "owner", "respond_min")
    return tidy(rec.select("window", "top_station", "cycle_s", "binding", "units_if_deferred", "action", "priority").join(jobs, "window", "left"), 4)


def state_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inference.predict_state(spark, sf_dir)
    return tidy(s.groupBy("station", D.lookup(F.col("state"), D.STATE_TAXONOMY).alias("taxonomy")).agg(F.count(F.lit(1)).alias("n")))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, entry_id, kind, station, body): a ledger a conversation, its turns in order."""
    t = X.table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(F.col("conv_id").alias("chain"), F.col("turn").cast("long").alias("entry_id")).agg(F.min(F.coalesce("role", F.lit(""))).alias("role"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    kind = F.when(F.col("entry_id") == 0, "FLOW_ALERT").when(F.col("role") == "assistant", "FLOW_DECISION").otherwise("OUTCOME")
    return t.select("chain", "entry_id", kind.alias("kind"), F.pmod("chain", F.lit(X.STATIONS)).cast("int").alias("station"), F.concat_ws("|", F.col("entry_id").cast("string"), "role", "text").alias("body"))


def ledger_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(D.chained(_ledger(spark, sf_dir), ["chain"], "entry_id", "body", GENESIS).select("chain", "entry_id", "prev_hash", "entry_hash"))


def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First broken entry of each chain of a ledger in which the second entry of every seventh chain was altered after the fact; null where it holds."""
    d = D.chained(_ledger(spark, sf_dir), ["chain"], "entry_id", "body", GENESIS)
    altered = (F.pmod("chain", F.lit(7)) == 0) & (F.col("entry_id") == 1)
    d = d.withColumn("body", F.when(altered, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    c = R.hash_chain_breaks(d, F.col("body"), GENESIS)
    return tidy(c.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~(F.col("linked") & F.col("intact")), F.col("entry_id"))).alias("first_break")))


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of station 3 in order, with their place."""
    d = _ledger(spark, sf_dir).where("station = 3")
    return tidy(d.select("chain", "entry_id", "kind", F.row_number().over(Window.partitionBy("chain").orderBy("entry_id")).alias("place")))


def incident_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with an alert, DECISIONED if a decision on their station is in the same chain's ledger."""
    d = _ledger(spark, sf_dir)
    alerts = d.where("kind = 'FLOW_ALERT'").select("chain", "station")
    made = d.where("kind = 'FLOW_DECISION'").select("chain").distinct().withColumn("yes", F.lit(True))
    return tidy(alerts.join(made, "chain", "left").select("chain", "station", F.when(F.col("yes"), "DECISIONED").otherwise("OPEN").alias("status")))


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly value of earlier warnings, by nation as plant: events from its customers, a margin from its suppliers' balance."""
    c = X.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("plant")).agg(F.count(F.lit(1)).alias("events"))
    per_hour, minutes, margin, rework, deploy, upkeep = 55.0, 12.0, 400.0, 150.0, 60_000.0, 12_000.0
    units = F.col("events") * minutes * (per_hour / 60) * 0.55
    d = c.select("plant", "events", units.alias("units"), (units * margin + F.col("events") * 6.0 * rework).alias("annual_value"))
    net = F.col("annual_value") - upkeep
    return tidy(d.select("plant", "events", "units", "annual_value", (deploy / F.greatest(net, F.lit(1e-9)) * 12).alias("payback_months"), ((F.col("annual_value") - deploy - upkeep) / (deploy + upkeep) * 100).alias("roi_pct")), 4)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signals each station gives: any value that is not null."""
    t = X.telemetry(spark, sf_dir)
    d = t.groupBy("station").agg(*[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in ("proc_time_s", "blocked_s", "starved_s")])
    return tidy(X.stations(spark, sf_dir).select("station", "tier").join(d, "station", "left").na.fill(False))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exports of each of twelve stations' log allow: flow needs state data of two stations or more, quality needs gate results and identities."""
    s = X.states(spark, sf_dir).select("station").distinct().agg(F.count(F.lit(1)).alias("n_with_state"))
    q = X.inspections(spark, sf_dir).agg(F.count("result").alias("n_results"), F.count("vehicle_id").alias("n_ids"))
    d = s.crossJoin(F.broadcast(q))
    flow_ok, quality_ok = F.col("n_with_state") >= 2, (F.col("n_results") > 0) & (F.col("n_ids") > 0)
    verdict = F.when(flow_ok & quality_ok, "FULL").when(flow_ok, "FLOW_ONLY").when(quality_ok, "QUALITY_ONLY").otherwise("NOT_VIABLE")
    coverage = F.col("n_with_state") / 12
    return tidy(d.select("n_with_state", coverage.alias("coverage"), verdict.alias("capability"), ((coverage > 0) & (coverage < 0.25)).alias("thin"), (coverage >= 0.99).alias("nothing_to_add")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (recommendation, work_orders, work_order_raise, waiting_cost, alert_bundle, state_taxonomy, ledger_build, ledger_verify, audit_trail, incident_status, roi, signals, readiness)}


def _of(name: str, module: object) -> str:
    return f"({module.SQL[name]})"  # type: ignore[attr-defined]


_ALERTS = f"""SELECT g."window", g.top_station, t.top_prob, g.group_prob, group_hi - group_lo + 1 AS group_size, g.group_prob >= 0.45 AS confident, coalesce(p.post, 0) AS p_supply, round(c.cycle_s, 4) AS cycle_s, round(round(c.cycle_s, 4), 9) > 60 AS binding, s.detected,
  CASE WHEN c.cycle_s IS NOT NULL THEN round(CASE WHEN round(c.cycle_s, 4) > 60 THEN 1 / 60.0::DOUBLE - 1 / round(c.cycle_s, 4) ELSE 0 END * 3600, 4) END AS units_lost,
  (SELECT max(d_blocked) FROM dev WHERE dev."window" = g."window" AND dev.station < g.top_station AND dev.station >= coalesce((SELECT min(station) FROM (SELECT station FROM stations WHERE tier <> 'MANUAL' AND station < g.top_station ORDER BY station DESC LIMIT 3)), 0)) AS upstream_blocked
  FROM {_of("candidate_group", inference)} g JOIN {_of("top_runner_up", inference)} t ON t."window" = g."window" LEFT JOIN posts p ON p."window" = g."window" AND p.k = -2 LEFT JOIN own c ON c."window" = g."window" AND c.station = g.top_station JOIN {_of("shadow", inference)} s ON s."window" = g."window\""""
_RULES = """SELECT *, CASE WHEN head OR supply THEN 'CHECK_INBOUND_MATERIAL' WHEN vague THEN 'ESCALATE_AMBIGUOUS' WHEN idle OR small THEN 'MONITOR' ELSE 'INSPECT_STATION' END AS action,
  CASE WHEN head OR supply THEN 'MEDIUM' WHEN vague OR idle OR small THEN 'LOW' WHEN group_prob >= 0.75 AND coalesce(units_lost, 0) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, head OR (NOT supply AND vague) AS abstained,
  CASE WHEN head THEN group_size WHEN supply THEN 0 WHEN vague OR idle OR small THEN group_size ELSE least(group_size, 3) END AS n_targets
  FROM (SELECT *, top_station <= 1 AND coalesce(upstream_blocked, -1) < 0.04 AS head, p_supply >= 0.25 AS supply, NOT confident OR group_prob < 0.45 AS vague, coalesce(NOT binding, false) AS idle, coalesce(units_lost < 1.5, false) AS small FROM alerts)"""
_BASE = f"""WITH RECURSIVE stations AS MATERIALIZED (SELECT station, tier FROM ({plain("SELECT * FROM stations")})), dev AS MATERIALIZED {_of("takt_deviation", flow)}, posts AS MATERIALIZED {_of("posterior", inference)},
own AS MATERIALIZED (SELECT "window", station, cycle_s FROM ({sql('SELECT "window", station, proc_time_s_mean AS cycle_s FROM wagg')}) UNION ALL SELECT "window", {X.BLIND}, cycle_s FROM ({sql('SELECT "window", cycle_s FROM cycles', inference._GAPS)})), alerts AS MATERIALIZED ({_ALERTS}), recs AS MATERIALIZED ({_RULES}),
jobs AS (SELECT *, CASE action WHEN 'INSPECT_STATION' THEN 'Maintenance technician (line-side)' WHEN 'CHECK_INBOUND_MATERIAL' THEN 'Material handler / logistics lead' ELSE 'Shift supervisor + process engineer' END AS owner,
  CASE WHEN abstained THEN 240 WHEN priority = 'HIGH' THEN 15 WHEN priority = 'MEDIUM' THEN 60 ELSE 240 END AS respond_min, CASE action WHEN 'INSPECT_STATION' THEN 'condition found' WHEN 'CHECK_INBOUND_MATERIAL' THEN 'material flowing' ELSE 'anything observed' END AS verify FROM recs WHERE action <> 'MONITOR')
"""
_LEDGER = """ledger AS (SELECT conv_id AS chain, CAST(turn AS BIGINT) AS entry_id, min(coalesce(role, '')) AS role, CAST(conv_id % 7 AS INTEGER) AS station, concat_ws('|', CAST(turn AS BIGINT)::VARCHAR, min(coalesce(role, '')), min(coalesce(text, ''))) AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
kinds AS (SELECT *, CASE WHEN entry_id = 0 THEN 'FLOW_ALERT' WHEN role = 'assistant' THEN 'FLOW_DECISION' ELSE 'OUTCOME' END AS kind, row_number() OVER (PARTITION BY chain ORDER BY entry_id) AS rn FROM ledger)"""
_CHAIN = f"""hashed AS (SELECT chain, entry_id, rn, '{GENESIS}' AS prev_hash, sha256('{GENESIS}' || body) AS entry_hash FROM kinds WHERE rn = 1 UNION ALL SELECT k.chain, k.entry_id, k.rn, h.entry_hash, sha256(h.entry_hash || k.body) FROM hashed h JOIN kinds k ON k.chain = h.chain AND k.rn = h.rn + 1)"""

SQL: dict[str, str] = {
    "recommendation": _BASE + f"""SELECT "window", {i('top_station')} AS top_station, action, priority, abstained, {i('n_targets')} AS n_targets, CASE WHEN abstained THEN CASE WHEN action = 'ESCALATE_AMBIGUOUS' THEN 'ESCALATE' ELSE 'ABSTAIN' END WHEN action = 'MONITOR' THEN 'WATCH' ELSE 'INVESTIGATE' END AS taxonomy FROM recs""",
    "work_orders": _BASE + f"""SELECT "window", action, owner, {i('respond_min')} AS respond_min, {i('2 * respond_min')} AS escalate_min, CASE WHEN priority = 'HIGH' THEN 'Process engineer' ELSE 'Shift supervisor' END AS escalate_to, verify FROM jobs""",
    "work_order_raise": _BASE + f"""SELECT {i('top_station')} AS top_station, min("window") AS "window", arg_min(action, "window") AS action, count(*) AS n_windows FROM jobs WHERE detected GROUP BY top_station""",
    "waiting_cost": f"""SELECT "window", binding, units_lost, CASE WHEN binding THEN units_lost END AS units_per_hour, {r('CASE WHEN binding THEN units_lost * 2 END', 4)} AS units_if_deferred, CASE WHEN binding THEN units_lost * 2 < 2 END AS defer_is_reasonable FROM {_of('ripple_forecast', inference)}""",
    "alert_bundle": _BASE + f"""SELECT a."window", {i('a.top_station')} AS top_station, a.cycle_s, a.binding, {r('CASE WHEN a.binding THEN a.units_lost * 2 END', 4)} AS units_if_deferred, a.action, a.priority, owner, {i('respond_min')} AS respond_min FROM recs a LEFT JOIN jobs j ON j."window" = a."window" WHERE a.detected""",
    "state_taxonomy": f"""SELECT station, CASE state WHEN 'NORMAL' THEN 'ALLOW' WHEN 'RECOVERING' THEN 'ALLOW' WHEN 'DEGRADING' THEN 'WATCH' WHEN 'WATCH' THEN 'WATCH' ELSE 'INVESTIGATE' END AS taxonomy, count(*) AS n FROM {_of('predict_state', inference)} GROUP BY 1, 2""",
    "ledger_build": f"WITH RECURSIVE {_LEDGER}, {_CHAIN} SELECT chain, entry_id, prev_hash, entry_hash FROM hashed",
    "ledger_verify": f"WITH {_LEDGER} SELECT chain, count(*) AS n, min(CASE WHEN chain % 7 = 0 AND entry_id = 1 THEN 1 END)::BIGINT AS first_break FROM kinds GROUP BY chain",
    "audit_trail": f"WITH {_LEDGER} SELECT chain, entry_id, kind, rn AS place FROM kinds WHERE station = 3",
    "incident_status": f"WITH {_LEDGER} SELECT chain, CAST(station AS BIGINT) AS station, CASE WHEN EXISTS (SELECT 1 FROM kinds d WHERE d.chain = k.chain AND d.kind = 'FLOW_DECISION') THEN 'DECISIONED' ELSE 'OPEN' END AS status FROM kinds k WHERE kind = 'FLOW_ALERT'",
    "roi": f"""SELECT {i('plant')} AS plant, events, {r('units', 4)} AS units, {r('v', 4)} AS annual_value, {r('60000 / greatest(v - 12000, 1e-9) * 12', 4)} AS payback_months, {r('(v - 72000) / 72000 * 100', 4)} AS roi_pct
      FROM (SELECT *, units * 400 + events * 6.0::DOUBLE * 150 AS v FROM (SELECT c_nationkey AS plant, count(*) AS events, count(*) * 12.0::DOUBLE * (55.0::DOUBLE / 60) * 0.55::DOUBLE AS units FROM customer GROUP BY 1))""",
    "signals": plain(f"""SELECT {i('s.station')} AS station, tier, coalesce(bool_or(proc_time_s IS NOT NULL), false) AND count(t.station) > 0 AS has_proc_time_s, coalesce(bool_or(blocked_s IS NOT NULL), false) AND count(t.station) > 0 AS has_blocked_s, coalesce(bool_or(starved_s IS NOT NULL), false) AND count(t.station) > 0 AS has_starved_s
      FROM stations s LEFT JOIN telemetry t ON t.station = s.station GROUP BY s.station, tier"""),
    "readiness": plain(f"""SELECT n AS n_with_state, {r('n / 12')} AS coverage, CASE WHEN n >= 2 AND q > 0 THEN 'FULL' WHEN n >= 2 THEN 'FLOW_ONLY' WHEN q > 0 THEN 'QUALITY_ONLY' ELSE 'NOT_VIABLE' END AS capability, n > 0 AND n / 12 < 0.25 AS thin, n / 12 >= 0.99 AS nothing_to_add
      FROM (SELECT (SELECT count(DISTINCT station) FROM states) AS n, (SELECT count(*) FROM inspections) AS q)"""),
}
