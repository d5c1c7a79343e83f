"""Streams: one file and a folder alike, sessions, late rows, state that outlives a restart, and results that never look ahead."""

from __future__ import annotations

import datetime as dt
import random
import shutil
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taktwerk.operators import intervals as I
from taktwerk.operators import runs as R
from taktwerk.plans import streams as P
from taktwerk.streaming import late as LT
from taktwerk.streaming import tops as TP
from taktwerk.streaming import windows as S

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def event(i, minutes, user=1, kind="a"):
    return (i, START + dt.timedelta(minutes=minutes), user, kind)


@pytest.fixture
def rows():
    rng = random.Random(2)
    return [event(i, rng.randrange(0, 14_400), rng.randrange(3), rng.choice("ab")) for i in range(400)]


def test_one_file_and_a_folder_give_the_same(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, EVENTS)
    one, many = tmp_path / "one", tmp_path / "many"
    df.coalesce(1).write.parquet(str(one / "tmp"))
    shutil.move(str(next((one / "tmp").glob("part-*"))), str(one / "events.parquet"))
    df.orderBy("ts").repartitionByRange(5, "ts").write.parquet(str(many / "events.parquet"))
    got = [sorted(map(tuple, S.drained(S.tumbling(S.event_stream(spark, str(d), files), "1 day", "1 day"), "t").collect())) for d, files in ((one, None), (many, None), (many, 10))]
    assert got[0] and got[0] == got[1] == got[2]


def test_sessions_by_hand(spark, tmp_path):
    rows = [event(0, 0), event(1, 20), event(2, 49), event(3, 200), event(4, 10, user=2), event(5, 1000, user=9)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    d = S.drained(S.sessions(S.event_stream(spark, str(tmp_path)), "user_id", "30 minutes", "0 seconds"), "s")
    got = sorted((r["user_id"], (r["start"] - START).seconds // 60, (r["end"] - START).seconds // 60, r["n"]) for r in d.collect())
    assert got == [(1, 0, 79, 3), (1, 200, 230, 1), (2, 10, 40, 1)]  # user 9's is still open


def test_late_rows_are_kept_beside_the_others(spark, tmp_path):
    sent = [(0, 100.0, 0), (1, 200.0, 0), (2, 150.0, 1), (3, 99.0, 1), (4, 900.0, 1), (5, 799.0, 2), (6, 800.0, 2), (7, None, 2), (7, 901.0, 2)]
    df = spark.createDataFrame(sent, "id long, t double, arrival int")
    src = LT.replay(df, "arrival", str(tmp_path / "sent"), 0, 1)
    split = LT.split_late(S.table_stream(spark, src, files=1), "t", 100.0, str(tmp_path / "root"))
    assert sorted((r["id"], r["late"]) for r in split.collect()) == [(0, False), (1, False), (2, False), (3, True), (4, False)]
    LT.replay(df, "arrival", src, 2, 2)
    again = LT.split_late(S.table_stream(spark, src, files=1), "t", 100.0, str(tmp_path / "root"))
    assert sorted((r["id"], r["late"], r["batch"]) for r in again.collect()) == [(0, False, 0), (1, False, 0), (2, False, 1), (3, True, 1), (4, False, 1), (5, True, 2), (6, False, 2), (7, False, 2), (7, True, 2)]


def series(n, stations=4, lines=2):
    rng = random.Random(7)
    return [(f"L{x}", w, k, None if rng.random() < 0.05 else rng.gauss(0, 2)) for x in range(lines) for w in range(n) for k in range(stations)]


def test_carried_state_equals_the_batch_also_after_a_restart(spark, tmp_path):
    rows = series(24)
    df = spark.createDataFrame(rows, "line string, window long, k int, llr double")
    sent = df.withColumn("arrival", F.floor(F.col("window") / 6).cast("int"))
    root, src = str(tmp_path / "root"), str(tmp_path / "sent")
    LT.replay(sent, "arrival", src, 0, 1)
    first = S.run_to_end(TP.smoothed_tops(S.table_stream(spark, src, files=1), "line", 4), root)
    assert first.count() == 2 * 12
    LT.replay(sent, "arrival", src, 2, 3)  # a new query goes on from the checkpoint
    got = S.run_to_end(TP.smoothed_tops(S.table_stream(spark, src, files=1), "line", 4), root)
    smooth = R.ewma(df, ["line", "k"], "window", "llr", "y")
    top = smooth.groupBy("line", "window").agg(F.max_by("k", F.struct(F.round("y", 9), -F.col("k"))).alias("top"), F.max(F.round("y", 9)).alias("y"))
    want = {(r["line"], r["window"]): (r["top"], round(r["y"], 6)) for r in top.collect()}
    assert {(r["line"], r["window"]): (r["top_station"], round(r["llr"], 6)) for r in got.collect()} == want
    near = {(r["line"], r["window"]): r["near"] for r in got.collect()}
    assert all(near[x, w] == (w > 0 and abs(want[x, w][0] - want[x, w - 1][0]) <= 1) for x, w in near)


def test_windows_wait_for_their_rows_and_late_ones_give_nothing(spark, tmp_path):
    rows = [("L", 0, 0, 1.0, 0), ("L", 1, 0, 5.0, 0), ("L", 1, 1, 0.0, 0), ("L", 0, 1, 2.0, 1), ("L", 0, 1, 99.0, 2), ("L", 2, 0, 0.0, 2), ("L", 2, 1, 0.0, 2)]
    sent = spark.createDataFrame(rows, "line string, window long, k int, llr double, arrival int")
    root, src = str(tmp_path / "root"), str(tmp_path / "sent")
    LT.replay(sent, "arrival", src, 0, 0)
    assert S.run_to_end(TP.smoothed_tops(S.table_stream(spark, src, files=1), "line", 2), root).count() == 0  # window 0 lacks a row
    LT.replay(sent, "arrival", src, 1, 2)
    got = S.run_to_end(TP.smoothed_tops(S.table_stream(spark, src, files=1), "line", 2), root)
    assert sorted((r["window"], r["top_station"], round(r["llr"], 4)) for r in got.collect()) == [(0, 1, 2.0), (1, 0, 3.2), (2, 0, 1.44)]


class Held:
    """A state's value and list without Spark."""

    def __init__(self):
        self.value, self.rows = None, []

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.rows) if self.value is None else self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []


def stepper(expected, alpha=0.55, patience=8):
    p = TP.SmoothTops(expected, alpha, patience, "line")
    p.series, p.pending = Held(), Held()

    def step(rows):
        w, k, v = zip(*rows)
        parts = pa.RecordBatch.from_pydict({"line": ["L"] * len(w), "window": pa.array(w, pa.int64()), "k": pa.array(k, pa.int32()), "llr": pa.array(v, pa.float64())})
        out = pd.concat(p.handleInputRows(("L",), (b.to_pandas() for b in TP.pack("line")(iter([parts]))), None))
        return list(zip(out["window"].tolist(), out["top_station"].tolist(), out["llr"].tolist(), out["near"].tolist()))

    return step


def test_rows_reach_the_state_in_one_row_a_line_and_batch():
    rows = pa.RecordBatch.from_pydict({"line": ["b", None, "a", "b", "a"], "window": [1, 2, 3, 4, None], "k": pa.array([0, 1, 2, None, 0], pa.int32()), "llr": [None, float("nan"), 0.5, 1.0, 1.0]})
    got = [r for b in TP.pack("line")(iter([rows])) for r in b.to_pylist()]
    assert got == [{"line": "b", "windows": [1], "ks": [0], "llrs": [0.0]}, {"line": None, "windows": [2], "ks": [1], "llrs": [0.0]}, {"line": "a", "windows": [3], "ks": [2], "llrs": [0.5]}]
    assert list(TP.pack("line")(iter([rows.slice(0, 0)]))) == []


def test_steps_equal_the_recursion_row_by_row():
    """Windows that lack rows are overtaken, hypotheses come late, rows are sent twice: as a plain loop over the windows has it."""
    rng = random.Random(9)
    rows = [(w, k, round(rng.gauss(0, 1), 1)) for w in range(60) for k in range(4) if rng.random() > 0.1 and (k < 3 or w > 20)]
    step, got = stepper(4, patience=3), []
    for a in range(0, 60, 15):
        now = [x for x in rows if a <= x[0] < a + 15]
        got += step([(w, k, v + 9) for w, k, v in now[:5]] + now)
    smooth, want = {}, []
    for w in sorted({x[0] for x in rows}):
        for _, k, v in (x for x in rows if x[0] == w):
            smooth[k] = 0.55 * v + (1 - 0.55) * smooth[k] if k in smooth else v
        best = min(smooth, key=lambda k: (-round(smooth[k], 9), k))
        want.append((w, best, smooth[best], bool(want) and abs(want[-1][1] - best) <= 1))
    assert len(got) >= 55 and got == want[: len(got)]
    assert step([(0, 0, 99.0)]) == []  # worked off long ago


def test_a_step_takes_time_in_proportion_to_its_windows():
    step, began = stepper(1), time.monotonic()
    assert len(step([(w, 0, float(w % 7)) for w in range(400_000)])) == 400_000
    assert time.monotonic() - began < 15


STATES = ["line", "window"]
#: Operators over an ordered series, each as a table of (line, window, result).
ORDERED = {
    "ewma": lambda d: R.ewma(d, ["line"], "window", "x", "y"),
    "trailing_slope": lambda d: R.trailing_slope(d, ["line"], "window", "x", "y", 5, 3),
    "run_length": lambda d: R.run_length(d, ["line"], ["window"], F.col("x") > 0).withColumnRenamed("run", "y"),
    "predict_states": lambda d: R.predict_states(d.withColumns({"confident": F.lit(True), "llr": F.col("x"), "cycle_s": F.col("x") + 1, "takt_s": F.lit(2.0), "slope": F.col("x") / 3}), ["line"], "window", detect=1.5, watch=0.8, rising=0.1).withColumnRenamed("state", "y"),
    "transitions": lambda d: P.transitions(d.withColumn("state", F.when(F.col("x") > 0, "WATCH").otherwise("NORMAL")), "line", "window").withColumnRenamed("event", "y"),
    "as_of_backward": lambda d: I.as_of(d.withColumn("t_s", F.col("window").cast("double")), d.where("window % 3 = 0").select("line", F.col("window").cast("double").alias("t_s"), F.col("x").alias("v")), keys=["line"], t="t_s", value="v", forward=False, bucket_s=4.0).withColumnRenamed("v", "y"),
    "gaps_behind": lambda d: R.hash_chain_breaks(d.select(F.col("line").alias("chain"), F.col("window").alias("entry_id"), F.lit("a").alias("prev_hash"), F.lit("a").alias("entry_hash")), F.lit("x"), "g").select(F.col("chain").alias("line"), F.col("entry_id").alias("window"), F.col("linked").alias("y")),
}


@pytest.mark.parametrize("name", ORDERED)
def test_results_for_a_prefix_are_the_prefix_of_the_results(spark, name):
    rng = random.Random(11)
    df = spark.createDataFrame([(x, w, round(rng.gauss(0, 1), 6)) for x in "ab" for w in range(30)], "line string, window long, x double")
    result = lambda d: {(r["line"], r["window"]): r["y"] for r in ORDERED[name](d).collect()}
    whole = result(df)
    assert whole
    for cut in (1, 7, 16, 29):
        assert result(df.where(F.col("window") < cut)) == {k: v for k, v in whole.items() if k[1] < cut}


def test_timeline_by_hand(spark):
    states = ["WATCH", "ACTIVE", "RECOVERING", "NORMAL", "PREDICTED", "WATCH", "NORMAL"]
    d = spark.createDataFrame([(1, w, s) for w, s in enumerate(states)], "station int, window long, state string")
    got = [tuple(r) for r in P.transitions(d, "station", "window").orderBy("window").collect()]
    assert got == [(1, 0, "raised", "NORMAL", "WATCH"), (1, 2, "cleared", "ACTIVE", "RECOVERING"), (1, 4, "raised", "NORMAL", "PREDICTED"), (1, 6, "cleared", "WATCH", "NORMAL")]
