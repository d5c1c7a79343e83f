"""A plant's own files: a mapping of names, the scans, one clock for all of them, and positions in place of identifiers."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.operators import intervals as I
from taktwerk.operators.quantiles import exact_medians
from taktwerk.operators.ranks import ordered_position

KINDS = ("telemetry", "states", "scans", "vehicles", "inspections", "environment")
#: Ways to write a time beside ISO, tried in this order.
FORMATS = ("yyyy/MM/dd HH:mm:ss[.SSSSSS]", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
TIMES = ("t_start_s", "t_depart_s", "t_s")
DURATIONS = ("blocked_s", "starved_s", "proc_time_s")
#: A buffer's level and capacity may be absent.
BUFFERS = ("buffer_level", "buffer_capacity")
UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class ExportSpec:
    """How a plant's files and columns map onto ours; ``columns`` holds, for each kind of file, the plant's name to ours.

    ``station_order`` names every station in process order, those without sensors included; ``time_scale`` brings plain numbers to seconds.
    """

    root: str
    files: dict[str, str] = field(default_factory=dict)
    columns: dict[str, dict[str, str]] = field(default_factory=dict)
    takt_s: float | None = None
    n_stations: int | None = None
    clock_sync_s: float | None = None
    time_scale: float = 1.0
    plant_name: str = ""
    station_order: tuple[str, ...] | None = None


def read_spec(path: str) -> ExportSpec:
    """The mapping file, JSON or (where PyYAML is there) YAML; without ``root`` the files lie beside it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        given = json.loads(text) or {}
    else:
        import yaml

        given = yaml.safe_load(text) or {}
    line: dict[str, Any] = given.get("line") or {}
    order = tuple(str(s) for s in line["stations"]) if line.get("stations") else None
    return ExportSpec(
        given.get("root") or os.path.dirname(os.path.abspath(path)), given.get("files") or {}, given.get("columns") or {},
        line.get("takt_s"), line.get("n_stations"), line.get("clock_sync_s"), float(given.get("time_scale", 1.0)), given.get("plant_name", ""), order,
    )


def template() -> str:
    """A mapping to fill in, as JSON."""
    example = {
        "plant_name": "my plant", "time_scale": 1.0, "line": {"takt_s": 60.0, "n_stations": 12, "clock_sync_s": 1.0, "stations": []},
        "files": {k: f"{k}.csv" for k in KINDS if k != "telemetry"},
        "columns": {
            "states": {"Equipment": "station", "StateCode": "state", "EventTime": "t_s"}, "scans": {"Equipment": "station", "SerialNo": "vehicle_id", "ReadTime": "t_s"},
            "vehicles": {"SerialNo": "vehicle_id", "ModelCode": "variant", "ShiftName": "shift"}, "inspections": {"SerialNo": "vehicle_id", "GateCode": "station", "Result": "result", "DefectCodes": "defect_types"},
        },
    }
    return json.dumps(example, indent=2)


def resolve(spark: SparkSession, spec: ExportSpec, kind: str) -> str | None:
    """The file's path, absolute or below the root; None if it is not named or not there. Asks the path's own file system."""
    name = spec.files.get(kind)
    if not name:
        return None
    path = name if "://" in name or name.startswith("/") else f"{spec.root.rstrip('/')}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def scan(spark: SparkSession, spec: ExportSpec, kind: str) -> DataFrame | None:
    """A file with our names. CSV stays text until a column is needed as a number or a time, so it is read once. Where a mapped column's new name is taken, the mapped one stays."""
    path = resolve(spark, spec, kind)
    if path is None:
        return None
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    names = {k: v for k, v in (spec.columns.get(kind) or {}).items() if k in df.columns}
    taken = set(names.values())
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if c in names or c not in taken])


def number(c: Column) -> Column:
    return c.try_cast("double")


def micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds since 1970; null for plain numbers and for what is no time. Times without a zone are taken as they stand."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    whole = lambda t: F.expr("0L") + F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind in ("timestamp_ntz", "date"):
        return whole(c.cast("timestamp_ntz"))
    if kind != "string":
        return F.lit(None).cast("long")
    t = F.trim(c)
    zoned = t.rlike(r":.*(Z|[+-]\d{2}:?\d{2})$")
    plain = F.coalesce(t.try_cast("timestamp_ntz"), *[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])
    return F.when(number(t).isNull(), F.when(zoned, F.unix_micros(t.try_cast("timestamp"))).otherwise(whole(plain)))


def earliest(frames: list[tuple[DataFrame, str]]) -> int | None:
    """The first time of all files in microseconds, None if none holds one: the zero that they share."""
    firsts = [df.agg(F.min(micros(df, name)).alias("t")) for df, name in frames if name in df.columns]
    return reduce(DataFrame.unionByName, firsts).agg(F.min("t")).first()[0] if firsts else None


def in_seconds(df: DataFrame, name: str, scale: float, epoch_us: int | None) -> DataFrame:
    """``df`` with the time in seconds from ``epoch_us``; plain numbers are scaled. What is neither is null."""
    if name not in df.columns:
        return df
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in NUMBERS or kind.startswith("decimal"):
        return df.withColumn(name, c.cast("double") * scale)
    since = (micros(df, name) - F.lit(epoch_us).cast("long")) / 1e6
    return df.withColumn(name, F.coalesce(number(c) * scale, since) if kind == "string" else since)


def dwell(states: DataFrame, scans: DataFrame, bucket_s: float) -> tuple[DataFrame, DataFrame]:
    """Telemetry (station, vehicle_id, t_start_s, t_depart_s, blocked_s, starved_s), one row a scan, and the log's coverage by station."""
    states = states.select("station", "state", "t_s", F.monotonically_increasing_id().alias("seq")).where("t_s IS NOT NULL")
    scans = scans.select("station", "vehicle_id", "t_s").where("t_s IS NOT NULL")
    # A unit may pass a station again: its windows are told apart by their times.
    windows = I.occupancy(scans).withColumn("vehicle_id", F.struct("vehicle_id", "t_start_s", "t_depart_s"))
    out = I.interval_overlap(windows, I.close_intervals(states), bucket_s)
    return out.select("station", "vehicle_id.*", "blocked_s", "starved_s"), I.state_coverage(states, scans)


def station_positions(telemetry: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """(station_key, station): the place in ``order``, or the rank by median departure. A station that ``order`` lacks is an error; one without any time has no rank."""
    if order:
        given = telemetry.sparkSession.createDataFrame(list(enumerate(order)), "station int, station_key string").select("station_key", "station")
        odd = telemetry.select(F.col("station").cast("string").alias("station_key")).distinct().join(given, "station_key", "left_anti").orderBy("station_key").limit(10).collect()
        if odd:
            raise ValueError("stations of the export that line.stations lacks: " + ", ".join(str(r[0]) for r in odd))
        return given
    med = exact_medians(telemetry, ["station"], "t_depart_s", "m")
    return med.select(F.col("station").cast("string").alias("station_key"), (F.row_number().over(Window.orderBy("m", "station")) - 1).alias("station"))  # one row a station


def build_positions(telemetry: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """(vehicle_key, vehicle_id): units in the order of their first departure, ties by identifier, numbered from 0."""
    first = telemetry.where("t_depart_s IS NOT NULL").groupBy(F.col("vehicle_id").cast("string").alias("vehicle_key")).agg(F.min("t_depart_s").alias("t"))
    placed = ordered_position(first.withColumn("hour", F.floor(F.col("t") / bucket_s)), "hour", ["t", "vehicle_key"], "vehicle_id")
    return placed.select("vehicle_key", "vehicle_id")


def _placed(df: DataFrame, units: DataFrame, stations: DataFrame | None, station_join: str = "inner") -> DataFrame:
    """``df`` by position, identifiers kept as keys; units without a position go."""
    df = df.drop("vehicle_key", "station_key").withColumn("vehicle_id", F.col("vehicle_id").cast("string")).withColumnRenamed("vehicle_id", "vehicle_key").join(units, "vehicle_key")
    if stations is not None and "station" in df.columns:
        df = df.withColumn("station", F.col("station").cast("string")).withColumnRenamed("station", "station_key").join(stations, "station_key", station_join)
    return df


def normalised(telemetry: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Telemetry with what can be derived: work is occupancy less blocked and starved time, not below 0; buffers are null, variant and shift unknown where absent."""
    t = telemetry
    if "proc_time_s" not in t.columns:
        held = F.lit(None).cast("double")
        if "t_start_s" in t.columns:
            held = F.col("t_depart_s") - F.col("t_start_s") - F.coalesce("blocked_s", F.lit(0.0)) - F.coalesce("starved_s", F.lit(0.0))
        t = t.withColumn("proc_time_s", F.when(held.isNotNull(), F.greatest(F.lit(0.0), held)))
    for c in BUFFERS:
        t = t.withColumn(c, number(F.col(c)) if c in t.columns else F.lit(None).cast("double"))
    if "variant" not in t.columns:
        t = t.join(vehicles.select("vehicle_id", "variant"), "vehicle_id", "left") if "variant" in vehicles.columns else t.withColumn("variant", F.lit(UNKNOWN))
    for c in ("shift", "variant"):
        if c not in vehicles.columns:
            vehicles = vehicles.withColumn(c, F.lit(UNKNOWN))
    return t, vehicles


def load(spark: SparkSession, spec: ExportSpec, bucket_s: float = 600.0) -> dict[str, DataFrame | None]:
    """The tables of an export: telemetry, vehicles, inspections, environment, state_coverage, station_map, vehicle_map; None for what the plant did not give.

    A telemetry file is taken as it is, otherwise state log and scans are joined; without either a FileNotFoundError. All files, the environment
    included, are measured from the earliest time of any. Without a vehicles file the units are those of the telemetry, in build order.
    """
    got = {k: scan(spark, spec, k) for k in KINDS}
    epoch = earliest([(df, c) for df in got.values() if df is not None for c in TIMES])
    timed = {k: None if df is None else reduce(lambda d, c: in_seconds(d, c, spec.time_scale, epoch), TIMES, df) for k, df in got.items()}
    coverage, tel = None, timed["telemetry"]
    if tel is not None:
        tel = reduce(lambda d, c: d.withColumn(c, number(F.col(c)) * spec.time_scale) if c in d.columns else d, DURATIONS, tel)
    elif timed["states"] is not None and timed["scans"] is not None:
        tel, coverage = dwell(timed["states"], timed["scans"], bucket_s)
    else:
        raise FileNotFoundError("an export needs telemetry, or states and scans; it has " + (", ".join(sorted(k for k, df in got.items() if df is not None)) or "none"))
    tel = settled(tel)  # both maps and the rows themselves start from it
    stations, units = station_positions(tel, spec.station_order), settled(build_positions(tel))
    vehicles = timed["vehicles"]
    vehicles = units.select(F.col("vehicle_key"), "vehicle_id") if vehicles is None else _placed(vehicles, units, None)
    insp = timed["inspections"]
    insp = None if insp is None else _placed(insp, units, stations, "left")
    out, vehicles = normalised(_placed(tel, units, stations), vehicles)
    return {"telemetry": out, "vehicles": vehicles, "inspections": insp, "environment": timed["environment"], "state_coverage": coverage, "station_map": stations, "vehicle_map": units}
