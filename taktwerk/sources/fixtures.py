"""Production-line tables projected from the star-schema and event tables: the shapes that the flow operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.operators.faults import KINDS
from taktwerk.operators.ranks import ordered_position

#: The line that the projection stands for: seven stations in a row, two places of buffer between them, one station without sensors, a gate at the end.
STATIONS, BLIND, GATE, BUFFER, TAKT_S = 7, 3, 6, 2, 60.0
SHIFT_LENGTH, SHIFTS = 500, 3
#: Whole microseconds of an event's time, with or without time zone.
MICROS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vehicle_key, vehicle_id, variant, shift): orders in date order, numbered from 0."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    placed = ordered_position(orders, "o_orderdate", ["o_orderkey"], "vehicle_id")
    shift = F.pmod(F.floor(F.col("vehicle_id") / SHIFT_LENGTH), F.lit(SHIFTS)).cast("int")
    return placed.select(F.col("o_orderkey").alias("vehicle_key"), "vehicle_id", F.col("o_orderpriority").alias("variant"), shift.alias("shift"))


def depart() -> Column:
    """When a visit ends: it follows from the other columns, so tables on disk need not hold it."""
    return TAKT_S * (F.col("vehicle_id") + F.col("station")) + F.col("proc_time_s")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of all stations: one row a (vehicle, station), repeated scans collapsed to their largest values."""
    # Dealt by order once: both the collapsing and the join with the vehicles find their rows there.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").repartition("l_orderkey")
    visits = lines.groupBy(F.col("l_orderkey").alias("vehicle_key"), (F.col("l_linenumber") - 1).alias("station")).agg(
        F.max("l_quantity").alias("proc_time_s"), F.max(60 * F.col("l_discount")).alias("blocked_s"), F.max(60 * F.col("l_tax")).alias("starved_s")
    )
    return visits.join(vehicles(spark, sf_dir), "vehicle_key").select("vehicle_id", "station", "variant", "shift", depart().alias("t_depart_s"), "proc_time_s", "blocked_s", "starved_s")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plant records: the passes of the stations that have sensors."""
    return passes(spark, sf_dir).where(F.col("station") != BLIND)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station dimension: the stations that the visits name, as few rows as the line is long. Zones, tiers and buffers are the plant's settings; the last station is the gate."""
    seen = table(spark, sf_dir, "lineitem").where("l_linenumber IS NOT NULL").groupBy((F.col("l_linenumber") - 1).cast("int").alias("station")).agg(F.count(F.lit(1)).alias("n_visits"))
    last = F.col("station") == F.max("station").over(Window.partitionBy())
    s = F.col("station")
    zone = F.when(s < 3, "body").when(s < 5, "trim").otherwise("final")
    tier = F.when(s == BLIND, "MANUAL").when(s % 2 == 0, "RICH").otherwise("BASIC")
    return seen.select("station", F.format_string("ST%02d", s).alias("station_id"), zone.alias("zone"), tier.alias("tier"), F.when(last, 1_000_000).otherwise(BUFFER).cast("long").alias("out_buffer"), last.alias("is_gate"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, state, t_s, seq): the change log of twelve stations; the last columns order it."""
    labels = F.create_map(*[F.lit(x) for kv in {"click": "RUNNING", "view": "BLOCKED", "error": "STARVED", "signup": "FAULT"}.items() for x in kv])
    e = _event_times(spark, sf_dir).where("event_type <> 'purchase'")
    return e.select(F.pmod("user_id", F.lit(12)).cast("int").alias("station"), labels[F.col("event_type")].alias("state"), "t_s", F.col("event_id").alias("seq"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, vehicle_id, t_s): one scan a unit."""
    e = _event_times(spark, sf_dir).where("event_type = 'purchase'")
    return e.select(F.pmod("user_id", F.lit(12)).cast("int").alias("station"), F.col("event_id").alias("vehicle_id"), "t_s")


def _event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole microseconds since the first as seconds."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr(MICROS_SQL).alias("us"))
    first = e.agg(F.min("us").alias("epoch"))
    return e.crossJoin(F.broadcast(first)).select("event_id", "user_id", "event_type", ((F.col("us") - F.col("epoch")) / 1e6).alias("t_s"))


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t_s, ambient_temp_c): hourly means of the event values, in whole thousandths."""
    e = table(spark, sf_dir, "events").select(F.expr(MICROS_SQL).alias("us"), F.round(F.col("value") * 100).cast("long").alias("v"))
    first = e.agg(F.min("us").alias("epoch"))
    e = e.crossJoin(F.broadcast(first)).select(F.floor((F.col("us") - F.col("epoch")) / 3_600_000_000).alias("hour"), "v")
    return e.groupBy("hour").agg(F.expr("(sum(v) * 10) div count(v) / 1000.0D").alias("ambient_temp_c")).select((F.col("hour") * 3600.0).alias("t_s"), "ambient_temp_c")


def inspections(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(vehicle_id, station, t_s, result, defect_types): one gate row a returned line, its codes joined by bars.

    With ``keep`` the failed ones only; it keeps their vehicles, parts and states on disk, so that what was shuffled to find the vehicles is gone before the parts' codes are looked up."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    v = vehicles(spark, sf_dir).select("vehicle_key", "vehicle_id")
    codes = F.when(F.col("l_returnflag") == "R", F.concat_ws("|", "l_linestatus", "p_type", "p_brand")).otherwise("")
    found = lines.join(v, F.col("l_orderkey") == F.col("vehicle_key"))
    if keep is not None:
        found = keep(found.where("l_returnflag = 'R'").select("vehicle_id", "l_partkey", "l_linestatus")).withColumn("l_returnflag", F.lit("R"))
    rows = found.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    t = TAKT_S * (F.col("vehicle_id") + GATE)
    return rows.select("vehicle_id", F.lit(GATE).alias("station"), t.alias("t_s"), F.when(F.col("l_returnflag") == "R", "FAIL").otherwise("PASS").alias("result"), codes.alias("defect_types"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of sensor faults, as ``operators.faults`` takes it: one a nation, spread over stations, kinds and the length of the run; some of a station overlap."""
    run = table(spark, sf_dir, "orders").agg((F.count(F.lit(1)) * TAKT_S).alias("run_s"))
    k = F.col("n_nationkey").cast("long")
    d = table(spark, sf_dir, "nation").where("n_nationkey IS NOT NULL").select(k.alias("k")).crossJoin(F.broadcast(run))
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    start = F.floor(F.col("run_s") * F.pmod(F.col("k") * 11, F.lit(25)) / 25).cast("double")
    length = F.floor(F.col("run_s") * (1 + F.pmod("k", F.lit(3))) / 20)
    return d.select(F.col("k").alias("fault_id"), F.pmod("k", F.lit(STATIONS)).cast("int").alias("station"), kind.alias("kind"), start.alias("t_from"), (start + length).alias("t_to"), F.lit(0.6).alias("noise_frac"), F.lit(300.0).alias("burst_on_s"), F.lit(300.0).alias("burst_off_s"))


#: The same projections in DuckDB SQL, as common table expressions that the oracles start with.
CTE = f"""
vehicles AS (SELECT o_orderkey AS vehicle_key, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS vehicle_id, o_orderpriority AS variant,
  CAST(((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // {SHIFT_LENGTH}) % {SHIFTS} AS INTEGER) AS shift FROM orders),
passes AS (SELECT v.vehicle_id, l_linenumber - 1 AS station, any_value(v.variant) AS variant, any_value(v.shift) AS shift,
  60.0::DOUBLE * (v.vehicle_id + l_linenumber - 1) + max(l_quantity) AS t_depart_s, max(l_quantity) AS proc_time_s, max(60 * l_discount) AS blocked_s, max(60 * l_tax) AS starved_s
  FROM lineitem JOIN vehicles v ON l_orderkey = v.vehicle_key GROUP BY v.vehicle_id, l_linenumber),
telemetry AS (SELECT * FROM passes WHERE station <> {BLIND}),
event_times AS (SELECT event_id, user_id, event_type, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t_s, value, ts FROM events),
states AS (SELECT CAST(user_id % 12 AS INTEGER) AS station, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'BLOCKED' WHEN 'error' THEN 'STARVED' ELSE 'FAULT' END AS state,
  t_s, event_id AS seq FROM event_times WHERE event_type <> 'purchase'),
scans AS (SELECT CAST(user_id % 12 AS INTEGER) AS station, event_id AS vehicle_id, t_s FROM event_times WHERE event_type = 'purchase'),
environment AS (SELECT hour * 3600.0::DOUBLE AS t_s, CAST((sum(v) * 10) // count(v) AS BIGINT) / 1000.0::DOUBLE AS ambient_temp_c FROM (
  SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS hour, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY hour),
inspections AS (SELECT v.vehicle_id, {GATE} AS station, 60.0::DOUBLE * (v.vehicle_id + {GATE}) AS t_s, CASE l_returnflag WHEN 'R' THEN 'FAIL' ELSE 'PASS' END AS result,
  CASE l_returnflag WHEN 'R' THEN concat_ws('|', l_linestatus, p_type, p_brand) ELSE '' END AS defect_types
  FROM lineitem JOIN vehicles v ON l_orderkey = v.vehicle_key JOIN part ON l_partkey = p_partkey),
stations AS (SELECT CAST(i AS INTEGER) AS station, format('ST{{:02d}}', i) AS station_id, CASE WHEN i < 3 THEN 'body' WHEN i < 5 THEN 'trim' ELSE 'final' END AS zone,
  CASE WHEN i = {BLIND} THEN 'MANUAL' WHEN i % 2 = 0 THEN 'RICH' ELSE 'BASIC' END AS tier, CAST(CASE WHEN i < last THEN {BUFFER} ELSE 1000000 END AS BIGINT) AS out_buffer, i = last AS is_gate
  FROM (SELECT i, max(i) OVER () AS last FROM (SELECT DISTINCT l_linenumber - 1 AS i FROM lineitem WHERE l_linenumber IS NOT NULL)))
"""
