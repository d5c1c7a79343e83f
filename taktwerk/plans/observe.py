"""What can be seen: views of the sensors, the graph's neighbourhoods, where a sensor helps most, and the event stream in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.operators import localise as L
from taktwerk.plans import flow, inference
from taktwerk.plans.base import Query, i, plain, r, sql, tidy
from taktwerk.plans.inference import SIGMA_B, SIGMA_S
from taktwerk.sources import fixtures as X
from taktwerk.streaming import windows as S

#: Cosine from which two stations count as confusable.
CONFUSABLE = 0.90
#: Shifts of the day by second: the night wraps over midnight.
SHIFTS = (("early", 21_600, 50_400), ("late", 50_400, 79_200), ("night", 79_200, 21_600))


def coverage_demotion(spark: SparkSession, sf_dir: str, keep: float = 0.5) -> DataFrame:
    """Sensors taken away until a share of the stations is left, by a fixed order; gates and the first station keep theirs."""
    st = X.stations(spark, sf_dir)
    guarded = F.col("is_gate") | (F.col("station") == 0) | (F.col("tier") == "MANUAL")
    order = F.row_number().over(Window.orderBy(guarded, F.pmod(F.col("station") * 5 + 3, F.lit(X.STATIONS))))
    drop = int(round((1 - keep) * X.STATIONS)) - 1
    return tidy(st.withColumn("o", order).select("station", F.when(~guarded & (F.col("o") <= drop), "MANUAL").otherwise(F.col("tier")).alias("tier")))


def slice_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles 500 to 999 with numbers from 0 and times from their first."""
    t = X.telemetry(spark, sf_dir).where("vehicle_id >= 500 AND vehicle_id < 1000")
    first = t.agg(F.min("t_depart_s").alias("t0"))
    return tidy(t.crossJoin(F.broadcast(first)).select((F.col("vehicle_id") - 500).alias("vehicle_id"), "station", (F.col("t_depart_s") - F.col("t0")).alias("t_depart_s")))


def run_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run in nominal, calibration and scored parts of 40, 20 and 40 per cent of the vehicles."""
    t = X.telemetry(spark, sf_dir)
    n = F.col("n_vehicles")
    part = F.when(F.col("vehicle_id") < F.floor(n * 0.4), "nominal").when(F.col("vehicle_id") < F.floor(n * 0.6), "calibration").otherwise("score")
    d = t.crossJoin(F.broadcast(flow.W.n_vehicles(t))).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("vehicle_id").alias("first"), F.max("vehicle_id").alias("last"))
    return tidy(d)


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inference._edges(spark, sf_dir)
    both = e.select(F.col("src").alias("station"), F.lit("next").alias("side"), F.col("dst").alias("other")).union(e.select("dst", F.lit("before"), "src"))
    return tidy(both.groupBy("station", "side").agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("others")))


def edge_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffer of every edge: given ones, else the chain's own."""
    e = inference._edges(spark, sf_dir)
    return tidy(e.join(X.stations(spark, sf_dir).select(F.col("station").alias("src"), "out_buffer"), "src").select("src", "dst", F.coalesce("buffer_capacity", "out_buffer").alias("buffer_capacity")))


def next_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = X.stations(spark, sf_dir)
    gates = st.where("is_gate").select(F.col("station").alias("gate"))
    return tidy(st.select("station").join(gates, F.col("gate") >= F.col("station"), "left").groupBy("station").agg(F.min("gate").alias("gate")))


def blind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of which one or both have no sensor."""
    st = X.stations(spark, sf_dir).select("station", (F.col("tier") == "MANUAL").alias("blind"))
    nxt = F.lead("blind").over(Window.orderBy("station"))
    return tidy(st.withColumn("b", nxt).where("b IS NOT NULL AND (blind OR b)").select("station", (F.col("station") + 1).alias("next"), (F.col("blind") & F.col("b")).alias("both")))


def _response(prop: DataFrame, seen: DataFrame) -> DataFrame:
    """(c, k, rival, cos, norm): the cosine of every two stations' responses under each sensor set c of ``seen`` (c, i)."""
    p = prop.join(seen, "i").select("c", "k", "i", (F.col("b") / SIGMA_B).alias("x"), (F.col("s") / SIGMA_S).alias("y"))
    norm = p.groupBy("c", "k").agg(F.sqrt(F.sum(F.col("x") ** 2 + F.col("y") ** 2)).alias("norm"))
    o = p.select("c", "i", F.col("k").alias("rival"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dot = p.join(o, ["c", "i"]).where("k <> rival").groupBy("c", "k", "rival").agg(F.sum(F.col("x") * F.col("x2") + F.col("y") * F.col("y2")).alias("dot"))
    d = dot.join(norm, ["c", "k"]).join(norm.select("c", F.col("k").alias("rival"), F.col("norm").alias("rn")), ["c", "rival"])
    return d.where("norm > 1e-12 AND rn > 1e-12").select("c", "k", "rival", F.round(F.col("dot") / (F.col("norm") * F.col("rn")), 9).alias("cos"), "norm")


def confusable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of stations that a chain of cosines of 0.90 or more connects; each named by its first. Stations squared rows at most."""
    seen = X.stations(spark, sf_dir).where("tier <> 'MANUAL'").select(F.lit(0).alias("c"), F.col("station").alias("i"))
    near = _response(inference._prop(spark, sf_dir), seen).where(F.col("cos") >= CONFUSABLE).select(F.col("k").alias("src"), F.col("rival").alias("dst"))
    near = spark.createDataFrame(near.collect(), "src int, dst int")  # of the station dimension
    reach = inference.T.reachable(spark, near)
    d = X.stations(spark, sf_dir).select("station").join(reach.select(F.col("src").alias("station"), "dst"), "station", "left").groupBy("station").agg(F.least(F.min("station"), F.min("dst")).alias("group_first"))
    return tidy(d)


def sensor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of three that have no sensor (1, 3 and 5) by what a sensor there would gain: its own ambiguity and the others' gain in separability over the median one."""
    st = X.stations(spark, sf_dir)
    blind = st.where("station IN (1, 3, 5)").select("station")
    base = st.join(blind, "station", "left_anti").select(F.lit(-1).alias("c"), F.col("station").alias("i"))
    more = blind.select(F.col("station").alias("c")).crossJoin(base.select("i")).union(blind.select("station", "station"))  # a few sets of a few stations
    r_ = _response(inference._prop(spark, sf_dir), base.union(more))
    best = r_.groupBy("c", "k").agg(F.max("cos").alias("ambiguity"), F.max("norm").alias("norm"), F.min(F.col("norm") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("cos") * F.col("cos")))).alias("sep")).select("c", "k", "ambiguity", F.round("sep", 9).alias("sep"))
    before = best.where("c = -1").select("k", F.col("ambiguity").alias("a0"), F.col("sep").alias("s0"))
    scale = before.where("s0 <> 0").agg(F.median("s0").alias("m"))
    others = best.where("c >= 0").join(before, "k").join(blind.withColumnRenamed("station", "k"), "k").crossJoin(F.broadcast(scale))
    gain = F.when(F.col("c") != F.col("k"), F.greatest(F.lit(0.0), (F.col("sep") - F.col("s0")) / F.col("m"))).otherwise(0.0)
    total = others.groupBy("c").agg(F.sum(gain).alias("gain")).join(before.select(F.col("k").alias("c"), "a0"), "c").select(F.col("c").alias("station"), F.round(F.col("a0") + F.col("gain"), 6).alias("total_gain"), F.col("a0").alias("own_ambiguity"))
    return tidy(total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_gain"), "station"))))


def suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that were named, by how often, most often first."""
    n = L.turning_point(flow.scored_table(spark, sf_dir)).groupBy("station").agg(F.count(F.lit(1)).alias("n"))
    return tidy(n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "station"))))


def shift_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans by the shift that their time of day falls in."""
    t = F.pmod(F.col("t_s"), F.lit(86_400.0))
    shift = F.lit(None).cast("string")
    for name, lo, hi in SHIFTS:
        shift = F.when((t >= lo) & (t < hi) if lo < hi else (t >= lo) | (t < hi), name).otherwise(shift)
    return tidy(X.scans(spark, sf_dir).groupBy(shift.alias("shift")).agg(F.count(F.lit(1)).alias("n")))


def split_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles dealt over two parallel branches by number."""
    return tidy(X.vehicles(spark, sf_dir).groupBy(F.pmod("vehicle_id", F.lit(2)).cast("int").alias("branch")).agg(F.count(F.lit(1)).alias("n"), F.min("vehicle_id").alias("first")))


def disturbance_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of a disturbance from 20,000 to 40,000 s with a ramp of 5,000 s, at each departure of station 2."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t_depart_s") - 20_000) / 5_000))
    on = F.col("t_depart_s").between(20_000.0, 40_000.0)
    return tidy(X.telemetry(spark, sf_dir).where("station = 2").select("vehicle_id", F.when(on, x).otherwise(0.0).alias("intensity")))


def build_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each variant in the build sequence, and the shifts that built it."""
    v = X.vehicles(spark, sf_dir)
    n = v.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("shift")), ",").alias("shifts"))
    return tidy(n.crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("total")))).select("variant", "n", (F.col("n") / F.col("total")).alias("share"), "shifts"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and day, from the stream; the last days, which the watermark has not passed, are not given."""
    d = S.drained(S.tumbling(S.event_stream(spark, sf_dir), "1 day", "0 seconds"), "tumbling")
    return tidy(d.select(F.unix_timestamp("start").alias("start"), "event_type", "n"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.drained(S.sliding(S.event_stream(spark, sf_dir), "2 days", "1 day", "0 seconds"), "sliding")
    return tidy(d.select(F.unix_timestamp("start").alias("start"), "n", "first_event"))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each, by type."""
    d = S.drained(S.first_seen(S.event_stream(spark, sf_dir), "1 day"), "first-seen")
    return tidy(d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (coverage_demotion, slice_rebase, run_split, successors, edge_buffers, next_gate, blind_pairs, confusable_groups, sensor_ranking, suspicion, shift_calendar, split_routing, disturbance_intensity, build_levels, stream_tumbling, stream_sliding, stream_first_seen)
}

_COS = f"""sets AS (SELECT -1 AS c, station AS i FROM stations WHERE {{base}} {{more}}), resp AS (SELECT c, k, prop.i, b / {SIGMA_B} AS x, s / {SIGMA_S} AS y FROM prop JOIN sets ON sets.i = prop.i), nrm AS (SELECT c, k, sqrt(sum(x * x + y * y)) AS n FROM resp GROUP BY c, k),
cs AS MATERIALIZED (SELECT a.c, a.k, b.k AS rival, round(sum(a.x * b.x + a.y * b.y) / (any_value(na.n) * any_value(nb.n)), 9) AS cos, any_value(na.n) AS n FROM resp a JOIN resp b ON a.c = b.c AND a.i = b.i AND a.k <> b.k JOIN nrm na ON na.c = a.c AND na.k = a.k JOIN nrm nb ON nb.c = b.c AND nb.k = b.k WHERE na.n > 1e-12 AND nb.n > 1e-12 GROUP BY a.c, a.k, b.k)"""
_DAY = "CAST(epoch(date_trunc('day', CAST(ts AS TIMESTAMP))) AS BIGINT)"
_SHIFT = " ".join(f"WHEN {f't >= {lo} AND t < {hi}' if lo < hi else f't >= {lo} OR t < {hi}'} THEN '{n}'" for n, lo, hi in SHIFTS)

SQL: dict[str, str] = {
    "coverage_demotion": plain(f"SELECT {i('station')} AS station, CASE WHEN NOT g AND o <= {round(0.5 * X.STATIONS) - 1} THEN 'MANUAL' ELSE tier END AS tier FROM (SELECT *, row_number() OVER (ORDER BY g, (station * 5 + 3) % {X.STATIONS}) AS o FROM (SELECT *, is_gate OR station = 0 OR tier = 'MANUAL' AS g FROM stations))"),
    "slice_rebase": plain(f"SELECT vehicle_id - 500 AS vehicle_id, {i('station')} AS station, {r('t_depart_s - min(t_depart_s) OVER ()')} AS t_depart_s FROM telemetry WHERE vehicle_id BETWEEN 500 AND 999"),
    "run_split": plain("SELECT CASE WHEN vehicle_id < floor(n * 0.4::DOUBLE) THEN 'nominal' WHEN vehicle_id < floor(n * 0.6::DOUBLE) THEN 'calibration' ELSE 'score' END AS part, count(*) AS n, min(vehicle_id) AS first, max(vehicle_id) AS last FROM telemetry, (SELECT max(vehicle_id) + 1 AS n FROM telemetry) GROUP BY 1"),
    "successors": plain(f"SELECT {i('station')} AS station, side, string_agg(other, ',' ORDER BY other) AS others FROM (SELECT src AS station, 'next' AS side, dst AS other FROM edges UNION ALL SELECT dst, 'before', src FROM edges) GROUP BY station, side", inference._E),
    "edge_buffers": plain(f"SELECT {i('src')} AS src, {i('dst')} AS dst, {i('cap')} AS buffer_capacity FROM edges", inference._E),
    "next_gate": plain(f"SELECT {i('s.station')} AS station, {i('min(g.station)')} AS gate FROM stations s LEFT JOIN stations g ON g.is_gate AND g.station >= s.station GROUP BY s.station"),
    "blind_pairs": plain(f"""SELECT {i('a.station')} AS station, {i('b.station')} AS "next", a.tier = 'MANUAL' AND b.tier = 'MANUAL' AS both FROM stations a JOIN stations b ON b.station = a.station + 1 WHERE a.tier = 'MANUAL' OR b.tier = 'MANUAL'"""),
    "confusable_groups": plain(f"SELECT {i('s.station')} AS station, {i('least(s.station, coalesce(min(dst), s.station))')} AS group_first FROM stations s LEFT JOIN reach r ON r.src = s.station GROUP BY s.station", inference._P, inference._PROP, _COS.format(base="tier <> 'MANUAL'", more=""),
      f"reach AS (SELECT k AS src, rival AS dst FROM cs WHERE cos >= {CONFUSABLE} UNION SELECT r.src, c.rival FROM reach r JOIN cs c ON c.k = r.dst AND c.cos >= {CONFUSABLE})"),
    "sensor_ranking": plain(f"""SELECT {i('station')} AS station, total_gain, own_ambiguity, row_number() OVER (ORDER BY total_gain DESC, station) AS rank FROM (SELECT b.c AS station, {r('any_value(o.a) + sum(CASE WHEN b.c <> b.k THEN greatest(0, (b.sep - z.sep) / (SELECT median(sep) FROM best WHERE c = -1 AND sep <> 0)) ELSE 0 END)')} AS total_gain, {r('any_value(o.a)')} AS own_ambiguity
      FROM best b JOIN best z ON z.c = -1 AND z.k = b.k JOIN best o ON o.c = -1 AND o.k = b.c WHERE b.c >= 0 AND b.k IN (1, 3, 5) GROUP BY b.c)""", inference._P, inference._PROP, _COS.format(base="station NOT IN (1, 3, 5)", more="UNION ALL SELECT b.station, s.station FROM stations b JOIN stations s ON s.station NOT IN (1, 3, 5) OR s.station = b.station WHERE b.station IN (1, 3, 5)"),
      "best AS MATERIALIZED (SELECT c, k, max(cos) AS a, round(min(n * sqrt(greatest(0, 1 - cos * cos))), 9) AS sep FROM cs GROUP BY c, k)"),
    "suspicion": sql(f"SELECT {i('station')} AS station, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, station) AS rank FROM turns GROUP BY station", *flow._TURNS),
    "shift_calendar": plain(f"SELECT CASE {_SHIFT} END AS shift, count(*) AS n FROM (SELECT t_s % 86400 AS t FROM scans) GROUP BY 1"),
    "split_routing": plain(f"SELECT {i('vehicle_id % 2')} AS branch, count(*) AS n, min(vehicle_id) AS first FROM vehicles GROUP BY 1"),
    "disturbance_intensity": plain(f"SELECT vehicle_id, {r('CASE WHEN t_depart_s BETWEEN 20000 AND 40000 THEN greatest(0, least(1, (t_depart_s - 20000) / 5000)) ELSE 0 END')} AS intensity FROM telemetry WHERE station = 2"),
    "build_levels": plain(f"SELECT variant, count(*) AS n, {r('count(*) / (SELECT count(*) FROM vehicles)')} AS share, (SELECT string_agg(shift, ',' ORDER BY shift) FROM (SELECT DISTINCT shift FROM vehicles w WHERE w.variant = v.variant)) AS shifts FROM vehicles v GROUP BY variant"),
    "stream_tumbling": f"SELECT {_DAY} AS start, event_type, count(*) AS n FROM events WHERE {_DAY} + 86400 <= (SELECT epoch(max(CAST(ts AS TIMESTAMP))) FROM events) GROUP BY 1, 2",
    "stream_sliding": f"SELECT start, count(*) AS n, min(event_id) AS first_event FROM (SELECT {_DAY} - d * 86400 AS start, event_id FROM events, (SELECT unnest([0, 1]) AS d)) WHERE start + 2 * 86400 <= (SELECT epoch(max(CAST(ts AS TIMESTAMP))) FROM events) GROUP BY 1",
    "stream_first_seen": "SELECT event_type, count(DISTINCT event_id) AS n, min(event_id) AS first FROM events GROUP BY event_type",
}
