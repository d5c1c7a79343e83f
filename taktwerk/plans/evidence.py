"""Queries of fused evidence, of telemetry under a list of sensor faults, and of the ledger that is appended to in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import faults as A
from taktwerk.operators import fusion as U
from taktwerk.operators import ledger as G
from taktwerk.operators import windows as W
from taktwerk.plans import decisions, flow, inference, risk
from taktwerk.plans.base import SPEC, Query, i, plain, r, sql, tidy
from taktwerk.sources import fixtures as X
from taktwerk.streaming.windows import new_root

CHANNELS, SEED, BUCKET_S = ["proc_time_s", "blocked_s", "starved_s"], 7, 3600.0


def ambiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that flow cannot tell apart, each with the first of its group."""
    return tidy(U.ambiguous_groups(spark, inference.separability_table(spark, sf_dir)))


def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's top by flow and, where it is one of a confusable group with evidence at the gates, the top by both."""
    tel = flow.telemetry_table(spark, sf_dir)
    bounds = W.window_aggregate(tel, SPEC, ["t_depart_s"], W.n_vehicles(tel)).groupBy("window").agg(F.min("t_depart_s_min").alias("t_lo"), F.max("t_depart_s_max").alias("t_hi"))
    pools = tel.groupBy(F.floor(F.col("vehicle_id") / risk.STEP).alias("window")).agg(F.min("t_depart_s").alias("t_lo"), F.max("t_depart_s").alias("t_hi"))
    tops = settled(inference.shadow_of(inference.posterior_table(spark, sf_dir, tel)).select("window", "top_station", "llr"))
    groups = U.ambiguous_groups(spark, inference.separability_table(spark, sf_dir))
    return tidy(U.fuse(tops, bounds, risk.quality_state(spark, sf_dir).select("window", "station", "llr"), pools, groups, BUCKET_S))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = settled(X.faults(spark, sf_dir))
    tel = settled(X.telemetry(spark, sf_dir).select("vehicle_id", "station", "t_depart_s", *[F.col(c).cast("double").alias(c) for c in CHANNELS]))
    return A.apply_faults(tel, faults, CHANNELS, seed=SEED, bucket_s=BUCKET_S)


def apply_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All telemetry under the list of faults."""
    return tidy(_faulty(spark, sf_dir).drop("t_depart_s"))


def fault_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each tag that the applied faults leave, a station."""
    n = _faulty(spark, sf_dir).groupBy("station", "data_quality").agg(F.count(F.lit(1)).alias("n"))
    return tidy(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("station"))))


def mask_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the faulty telemetry without those in which a sensor only repeats itself."""
    d = settled(_faulty(spark, sf_dir))
    w = W.window_aggregate(d, SPEC, ["proc_time_s"], W.n_vehicles(d))
    return tidy(A.mask_suspect(A.stale_suspect(w)).select("window", "station", "proc_time_s_mean", "proc_time_s_count"))


def _appended(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a ledger that got its alerts first, then two turns of each chain, then the rest."""
    rows = settled(decisions._ledger(spark, sf_dir).select("chain", "entry_id", "body"))
    root = new_root(spark, "ledger")
    for batch, part in enumerate((F.col("entry_id") == 0, F.col("entry_id").between(1, 2), F.col("entry_id") > 2)):
        G.append(spark, root, batch, rows.where(part), "entry_id")
    return root


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the ledger after three appends: the hashes of one that was built at once."""
    return tidy(G.entries(spark, _appended(spark, sf_dir)).select("batch", "chain", "entry_id", "prev_hash", "entry_hash"))


def ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the three appends and how each batch compares with it."""
    root = _appended(spark, sf_dir)
    return tidy(G.manifest(spark, root).join(G.verify_batches(spark, root), "batch"))


def ledger_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain of the appended ledger: entries and the first broken one."""
    return tidy(G.verify_chains(G.entries(spark, _appended(spark, sf_dir))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (ambiguous_groups, fusion, apply_faults, fault_quality, mask_suspect, ledger_append, ledger_batches, ledger_chains)}

_GROUPS = f"""sep AS MATERIALIZED ({inference.SQL['separability']}),
near AS (SELECT station AS a, confusable_with AS b FROM sep WHERE ambiguity >= {U.CONFUSABLE} UNION SELECT confusable_with, station FROM sep WHERE ambiguity >= {U.CONFUSABLE}),
linked AS (SELECT a, b FROM near UNION SELECT l.a, n.b FROM linked l JOIN near n ON n.a = l.b),
groups AS (SELECT a AS station, least(a, min(b)) AS grp FROM linked GROUP BY a)"""
_FUSED = f"""flowtop AS MATERIALIZED ({inference.SQL['shadow']}), qstate AS MATERIALIZED ({risk.SQL['quality_state']}),
fb AS (SELECT "window", min(t_lo) AS t_lo, max(t_hi) AS t_hi FROM wagg GROUP BY "window"),
qb AS (SELECT vehicle_id // {risk.STEP} AS "window", min(t_depart_s) AS t_lo, max(t_depart_s) AS t_hi FROM telemetry GROUP BY 1),
seen AS (SELECT f."window", q.station, sum(q.llr) AS q FROM fb f JOIN qb b ON b.t_hi >= f.t_lo AND b.t_lo <= f.t_hi JOIN qstate q ON q."window" = b."window" GROUP BY 1, 2),
scores AS (SELECT t."window", m.station, seen.q, round(CASE WHEN m.station = t.top_station THEN t.llr ELSE 0 END + coalesce(seen.q, 0), 9) AS score FROM flowtop t JOIN groups g ON g.station = t.top_station JOIN groups m ON m.grp = g.grp LEFT JOIN seen ON seen."window" = t."window" AND seen.station = m.station),
ordered AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score DESC, station) AS rk FROM scores),
best AS (SELECT "window", max(CASE WHEN rk = 1 THEN station END) AS best, max(CASE WHEN rk = 1 THEN score END) - coalesce(max(CASE WHEN rk = 2 THEN score END), 0) AS margin FROM ordered GROUP BY "window" HAVING max(q) > 0)"""


def _round_sql(n: int) -> str:
    """The n-th fault of each station, as the tables st<n> and tel<n + 1>."""
    hit = "t_depart_s >= t_from AND t_depart_s < t_to"
    stats = ", ".join(
        f"round(stddev_pop(CASE WHEN {hit} THEN {c} END), 9) AS sd_{c}, round(avg(CASE WHEN {hit} THEN abs({c}) END) * {A.FLAT_SHARE}::DOUBLE + {A.LEAST_SPREAD}::DOUBLE, 9) AS flat_{c}, arg_max({c}, (t_depart_s, vehicle_id)) FILTER (WHERE t_depart_s < t_from) AS last_{c}, arg_min({c}, (t_depart_s, vehicle_id)) FILTER (WHERE {hit}) AS first_{c}" for c in CHANNELS
    )
    word = lambda c, a: f"(('0x' || substr(sha256(concat_ws(':', {SEED}, fault_id, d.station, vehicle_id, '{c}')), {a}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    noise = lambda c: f"sqrt(-2.0::DOUBLE * ln({word(c, 1)})) * cos(2.0::DOUBLE * pi() * ({word(c, 9)}))"
    spread = lambda c: f"greatest(CASE WHEN sd_{c} > 0 THEN sd_{c} ELSE flat_{c} END, {A.LEAST_SPREAD}::DOUBLE)"
    new = ", ".join(f"CASE WHEN hit AND kind = 'NOISY' THEN greatest(0, round({c} + noise_frac * {spread(c)} * {noise(c)}, 9)) WHEN hit AND kind = 'STALE' THEN coalesce(last_{c}, first_{c}) ELSE {c} END AS {c}" for c in CHANNELS)
    return f"""st{n} AS MATERIALIZED (SELECT f.station, {stats} FROM tel{n} t JOIN changing f ON f.station = t.station AND f.turn = {n} GROUP BY f.station),
tel{n + 1} AS MATERIALIZED (SELECT vehicle_id, d.station, t_depart_s, {new}, CASE WHEN hit THEN kind ELSE data_quality END AS data_quality FROM (
  SELECT t.*, f.fault_id, f.kind, f.noise_frac, coalesce({hit}, false) AS hit FROM tel{n} t LEFT JOIN changing f ON f.station = t.station AND f.turn = {n}) d LEFT JOIN st{n} ON st{n}.station = d.station)"""


_FAULTS = f"""run AS (SELECT count(*) * {X.TAKT_S}::DOUBLE AS run_s FROM orders),
faults AS (SELECT k AS fault_id, k % {X.STATIONS} AS station, [{', '.join(repr(x) for x in A.KINDS)}][k % 4 + 1] AS kind, floor(run_s * (k * 11 % 25) / 25) AS t_from, floor(run_s * (k * 11 % 25) / 25) + floor(run_s * (1 + k % 3) / 20) AS t_to, 0.6::DOUBLE AS noise_frac FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation), run),
changing AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY fault_id) - 1 AS turn FROM faults WHERE kind IN ('NOISY', 'STALE')),
tel0 AS (SELECT vehicle_id, station, t_depart_s, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CHANNELS)}, 'OBSERVED' AS data_quality FROM telemetry),
{_round_sql(0)},
{_round_sql(1)},
faulty AS MATERIALIZED (SELECT * FROM tel2 t WHERE NOT EXISTS (SELECT 1 FROM faults f WHERE f.station = t.station AND t_depart_s >= t_from AND t_depart_s < t_to AND (kind = 'DROPOUT' OR kind = 'INTERMITTENT' AND (t_depart_s - t_from) % 600 >= 300)))"""
_MASK = f"""fw AS (SELECT w AS "window", {SPEC.warmup} + {SPEC.stride} * w AS v_start FROM (SELECT unnest(range(0, greatest(0, (max(vehicle_id) + 1 - {SPEC.warmup} - {SPEC.width}) // {SPEC.stride} + 1))) AS w FROM faulty))"""
_HASHED = f"{decisions._LEDGER}, {decisions._CHAIN}, put AS (SELECT CASE WHEN entry_id = 0 THEN 0 WHEN entry_id <= 2 THEN 1 ELSE 2 END::BIGINT AS batch, chain, rn AS entry_id, prev_hash, entry_hash FROM hashed)"

SQL: dict[str, str] = {
    "ambiguous_groups": f"WITH RECURSIVE {_GROUPS} SELECT {i('station')} AS station, {i('grp')} AS grp FROM groups",
    "fusion": sql(f"""SELECT t."window", t.top_station, t.llr, {r('margin')} AS fused_llr_margin, best IS NOT NULL AS is_fused, {i('coalesce(best, t.top_station)')} AS fused_top_station FROM flowtop t LEFT JOIN best b ON b."window" = t."window\"""", _GROUPS, _FUSED),
    "apply_faults": plain(f"SELECT vehicle_id, {i('station')} AS station, {', '.join(f'{r(c)} AS {c}' for c in CHANNELS)}, data_quality FROM faulty", _FAULTS),
    "fault_quality": plain(f"SELECT {i('station')} AS station, data_quality, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY station)')} AS share FROM faulty GROUP BY station, data_quality", _FAULTS),
    "mask_suspect": plain(f"""SELECT "window", {i('station')} AS station, {r('avg(proc_time_s)')} AS proc_time_s_mean, count(proc_time_s) AS proc_time_s_count FROM faulty JOIN fw ON vehicle_id >= v_start AND vehicle_id < v_start + {SPEC.width}
      GROUP BY "window", station HAVING NOT (coalesce(stddev_samp(proc_time_s), 0) < 0.05 AND count(proc_time_s) >= 6)""", _FAULTS, _MASK),
    "ledger_append": f"WITH RECURSIVE {_HASHED} SELECT batch, chain, entry_id, prev_hash, entry_hash FROM put",
    "ledger_batches": f"WITH RECURSIVE {_HASHED} SELECT batch, count(*) AS n_entries, count(DISTINCT chain) AS n_chains, CAST(sum(('0x' || substr(entry_hash, 1, 15))::BIGINT) AS VARCHAR) AS digest, 'whole' AS status FROM put GROUP BY batch",
    "ledger_chains": f"WITH {decisions._LEDGER} SELECT chain, count(*) AS n, NULL::BIGINT AS first_break FROM kinds GROUP BY chain",
}
