"""Stream queries: sessions, late rows, carried state, and the timeline of a station's states."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taktwerk.functions.lineage import settled
from taktwerk.plans import inference
from taktwerk.plans.base import Query, i, r, sql, tidy
from taktwerk.sources import fixtures as X
from taktwerk.streaming import late as LT
from taktwerk.streaming import tops as TP
from taktwerk.streaming import windows as S

#: Files that the replays arrive in; every so-manieth event comes two files late; seconds that rows may lag.
ARRIVALS, EVERY, DELAY_S = 6, 50, 3600.0
#: Lines that the windows are of; files that their scores arrive in, at least; windows a file, at most: a trigger holds one file's rows.
LINES, TOPS_FILES, FILE_WINDOWS = 1, 4, 500_000
GAP_S = 43_200
#: States from the least to the most urgent; a station is on watch from the third.
RANKS = ("NORMAL", "RECOVERING", "DEGRADING", "WATCH", "PREDICTED", "ACTIVE")
ON_WATCH = RANKS.index("WATCH")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, from the stream; those that the watermark has not passed are not given."""
    d = S.drained(S.sessions(S.event_stream(spark, sf_dir), "user_id", f"{GAP_S} seconds", "0 seconds"), "sessions")
    return tidy(d.select("user_id", (F.unix_micros("start") / 1e6).alias("start_s"), "n"), 3)


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in six files, some two files late, told apart by the marks of the files before theirs."""
    e = X.table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(X.MICROS_SQL).alias("us"))
    ends = F.broadcast(e.agg(F.min("us").alias("lo"), F.max("us").alias("hi")))
    span = F.floor((F.col("us") - F.col("lo")) * ARRIVALS / (F.col("hi") - F.col("lo") + 1))
    arrival = F.least(F.lit(ARRIVALS - 1), span + F.when(F.col("event_id") % EVERY == 7, 2).otherwise(0)).cast("int")
    sent = settled(e.crossJoin(ends).select("event_id", "event_type", (F.col("us") / 1e6).alias("t_s"), arrival.alias("arrival")))
    root = S.new_root(spark, "late")
    split = LT.split_late(S.table_stream(spark, LT.replay(sent, "arrival", f"{root}/sent", 0, ARRIVALS - 1), files=1), "t_s", DELAY_S, root)
    return tidy(split.groupBy("batch", "event_type").agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late")))


def stream_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely station of each window by smoothed likelihood, carried as state from file to file."""
    s = inference.score_table(spark, sf_dir).where("k >= 0").select(F.lit("line-1").alias("line"), F.col("window").cast("long").alias("window"), F.col("k").cast("int").alias("k"), "llr")
    # The scores are settled: a copy with arrivals would only be read once.
    n_windows = (s.agg(F.max("window")).first()[0] or 0) + 1
    files = max(TOPS_FILES, math.ceil(n_windows / FILE_WINDOWS))
    sent = s.withColumn("arrival", F.floor(F.col("window") * files / n_windows).cast("int"))
    root = S.new_root(spark, "tops")
    stream = S.table_stream(spark, LT.replay(sent, "arrival", f"{root}/sent", 0, files - 1), files=1)
    return tidy(S.run_to_end(TP.smoothed_tops(stream, "line", X.STATIONS, inference.ALPHA), root, LINES).select("window", "top_station", "llr", "near"))


def transitions(states: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, event, state_before, state): where a key's state goes on watch or leaves it; a first row counts when it is on watch."""
    w = Window.partitionBy(key).orderBy(order)
    rank = lambda c: F.array_position(F.array(*map(F.lit, RANKS)), F.col(c)) - 1
    d = states.withColumn("state_before", F.lag("state", 1, "NORMAL").over(w))
    d = d.withColumns({"a": rank("state_before") >= ON_WATCH, "b": rank("state") >= ON_WATCH}).where("a <> b")
    return d.select(key, order, F.when(F.col("b"), "raised").otherwise("cleared").alias("event"), "state_before", "state")


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each station went on watch and when that was over."""
    return tidy(transitions(inference.predict_state(spark, sf_dir), "station", "window"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (stream_sessions, stream_late, stream_tops, event_timeline)}

_IN = ", ".join(f"'{s}'" for s in RANKS[ON_WATCH:])
SQL: dict[str, str] = {
    "stream_sessions": f"""SELECT user_id, {r('min(t)', 3)} AS start_s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS s FROM (
      SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t, CASE WHEN epoch_us(CAST(ts AS TIMESTAMP)) - lag(epoch_us(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts) <= {GAP_S}000000 THEN 0 ELSE 1 END AS new FROM events))
      GROUP BY user_id, s HAVING max(t) + {GAP_S} <= (SELECT max(epoch_ms(CAST(ts AS TIMESTAMP))) / 1e3 FROM events)""",
    "stream_late": f"""WITH e AS (SELECT event_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM events), ends AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
    sent AS (SELECT event_type, us / 1e6 AS t, least({ARRIVALS - 1}, CAST(floor((us - lo) * {ARRIVALS} / (hi - lo + 1)) AS BIGINT) + CASE WHEN event_id % {EVERY} = 7 THEN 2 ELSE 0 END) AS batch FROM e, ends),
    marks AS (SELECT a.batch, (SELECT max(t) FROM sent b WHERE b.batch < a.batch) AS mark FROM (SELECT DISTINCT batch FROM sent) a)
    SELECT batch, event_type, {i('count_if(NOT coalesce(t < mark - ' + str(DELAY_S) + ', false))')} AS on_time, {i('count_if(coalesce(t < mark - ' + str(DELAY_S) + ', false))')} AS late FROM sent JOIN marks USING (batch) GROUP BY batch, event_type""",
    "stream_tops": sql(f"""SELECT "window", {i('k')} AS top_station, {r('y')} AS llr, coalesce(abs(lag(k) OVER (ORDER BY "window") - k) <= 1, false) AS near FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY round(y, 9) DESC, k) AS rk FROM smooth) WHERE rk = 1""", *inference._CHAIN, inference._POST),
    "event_timeline": sql(f"""SELECT {i('station')} AS station, "window", CASE WHEN state IN ({_IN}) THEN 'raised' ELSE 'cleared' END AS event, state_before, state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY station ORDER BY "window"), 'NORMAL') AS state_before FROM st)
      WHERE (state IN ({_IN})) <> (state_before IN ({_IN}))""", inference._STATES),
}
