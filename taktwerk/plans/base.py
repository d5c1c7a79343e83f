"""What the query modules share: tidy results and the SQL that the oracles start with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.operators.windows import WindowSpec
from taktwerk.sources.fixtures import BUFFER, CTE, STATIONS, TAKT_S

Query = Callable[[SparkSession, str], DataFrame]
SPEC = WindowSpec.for_line([BUFFER] * (STATIONS - 1) + [1_000_000])
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Whole numbers as long, others rounded and without a negative zero: results that two engines can agree on."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("long")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def r(expr: str, digits: int = DIGITS) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE"


def i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


WINDOWS = f"""
nv AS (SELECT max(vehicle_id) + 1 AS n FROM telemetry),
wins AS (SELECT w AS "window", {SPEC.warmup} + {SPEC.stride} * w AS v_start, {SPEC.warmup} + {SPEC.stride} * w + {SPEC.width} AS v_end
  FROM (SELECT unnest(range(0, greatest(0, (n - {SPEC.warmup} - {SPEC.width}) // {SPEC.stride} + 1))) AS w FROM nv)),
tw AS (SELECT w."window", w.v_start, w.v_end, t.* FROM telemetry t JOIN wins w ON t.vehicle_id >= w.v_start AND t.vehicle_id < w.v_end),
wagg AS (SELECT "window", station, avg(proc_time_s) AS proc_time_s_mean, stddev_samp(proc_time_s) AS proc_time_s_std, count(proc_time_s) AS proc_time_s_count,
  avg(blocked_s) AS blocked_s_mean, avg(starved_s) AS starved_s_mean, max(blocked_s) AS blocked_s_max, min(t_depart_s) AS t_lo, max(t_depart_s) AS t_hi FROM tw GROUP BY "window", station),
fracs AS (SELECT *, blocked_s_mean / {TAKT_S} AS blocked_frac, starved_s_mean / {TAKT_S} AS starved_frac FROM wagg),
centers AS (SELECT station, median(blocked_frac) AS bc, median(starved_frac) AS sc FROM fracs GROUP BY station),
scored AS (SELECT f.*, bc, sc, round(blocked_frac - bc, 9) AS d_blocked, round(starved_frac - sc, 9) AS d_starved FROM fracs f JOIN centers USING (station))
"""


def sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CTE.strip().rstrip(","), WINDOWS.strip(), *more]) + "\n" + body


def plain(body: str, *more: str) -> str:
    """Without the windows."""
    return "WITH RECURSIVE " + ",\n".join([CTE.strip().rstrip(","), *more]) + "\n" + body
