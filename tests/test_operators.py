from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import intervals, runs, windows
from taktwerk.operators.ranks import ordered_position
from taktwerk.sources import fixtures


def test_positions_follow_the_order(spark):
    rows = [(d, k) for d in ("b", "a", None) for k in (3, 1, 2)]
    out = ordered_position(spark.createDataFrame(rows, "d string, k int"), "d", ["k"], "p").orderBy("p").collect()
    assert [r.p for r in out] == list(range(9))
    assert [(r.d, r.k) for r in out] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))


def test_open_interval_ends_with_the_log(spark):
    log = spark.createDataFrame([(0, "RUNNING", 0.0, 0), (0, "BLOCKED", 10.0, 1), (1, "Outfeed-Full", 20.0, 2), (1, "INFEED_EMPTY", 20.0, 3)], "station int, state string, t_s double, seq long")
    out = {(r.station, r.t0, r.state_kind): r.t1 for r in intervals.close_intervals(log).collect()}
    assert out == {(0, 0.0, "other"): 10.0, (0, 10.0, "blocked_s"): 20.0, (1, 20.0, "blocked_s"): 20.0, (1, 20.0, "starved_s"): 20.0}


def test_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    scans = sorted((rng.randrange(2), rng.uniform(0, 1000)) for _ in range(60))
    log = [(s, t, t + rng.uniform(0, 80), rng.choice(["blocked_s", "starved_s", "other"])) for s, t in ((rng.randrange(2), rng.uniform(0, 950)) for _ in range(80))]
    occ = intervals.occupancy(spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(scans)], "station int, vehicle_id long, t_s double"))
    got = {r.vehicle_id: (r.blocked_s, r.starved_s) for r in intervals.interval_overlap(occ, spark.createDataFrame(log, "station int, t0 double, t1 double, state_kind string"), 60.0).collect()}
    for r in occ.collect():
        want = [sum(max(0.0, min(t1, r.t_depart_s) - max(t0, r.t_start_s)) for s, t0, t1, k in log if s == r.station and k == kind) for kind in ("blocked_s", "starved_s")]
        assert got[r.vehicle_id] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("forward", [True, False])
def test_as_of_equals_brute_force(spark, forward):
    rng = random.Random(4)
    right = [(float(t), float(i)) for i, t in enumerate(sorted(rng.sample(range(100, 900), 20)))]
    left = [(i, float(rng.randrange(0, 1000))) for i in range(80)]
    out = intervals.as_of(spark.createDataFrame(left, "id int, t_s double"), spark.createDataFrame(right, "t_s double, v double"), keys=[], t="t_s", value="v", forward=forward, bucket_s=130.0)
    got = {r.id: r.v for r in out.collect()}
    for i, t in left:
        fit = [v for u, v in right if (u >= t if forward else u <= t)]
        assert got[i] == (fit[0 if forward else -1] if fit else (right[-1][1] if forward else right[0][1]))


def test_counts_strictly_before(spark):
    left = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 5.0)], "k int, t double")
    right = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (1, 0.0)], "k int, t double")
    assert {r.t: r.n_before for r in intervals.inequality_count(left, right, "k", "t").collect()} == {1.0: 0, 2.0: 1, 5.0: 3}


def test_panes_equal_copied_windows(spark):
    rng = random.Random(5)
    rows = [(v, s, float(rng.randrange(50))) for v in range(90) for s in range(3) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "vehicle_id long, station int, x double")
    spec, total = windows.WindowSpec(20, 5, 7), windows.n_vehicles(df)
    panes = windows.window_aggregate(df, spec, ["x"], total).select("window", "station", F.round("x_mean", 6), F.round("x_std", 6), "x_max", "x_min", "x_count")
    copied = windows.in_windows(df, spec, total).groupBy("window", "station").agg(F.round(F.avg("x"), 6), F.round(F.stddev_samp("x"), 6), F.max("x"), F.min("x"), F.count("x"))
    assert sorted(map(tuple, panes.collect())) == sorted(map(tuple, copied.collect()))
    assert panes.select("window").distinct().count() == spec.count(90)


def test_smoothing_equals_recursion(spark):
    xs = [random.Random(6).uniform(-5, 5) for _ in range(150)]
    out = runs.ewma(spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "k int, i int, x double"), ["k"], "i", "x", "y").orderBy("i").collect()
    y = xs[0]
    for r, x in zip(out[1:], xs[1:], strict=True):
        y = 0.55 * x + 0.45 * y
        assert r.y == pytest.approx(y, abs=1e-12)


def test_states_equal_recursion(spark):
    rng = random.Random(7)
    rows = [(0, i, rng.random() < 0.4, rng.choice([0.1, 0.6, 1.2]), rng.choice([50.0, 70.0]), 60.0, rng.choice([-0.3, -0.1, 0.0, 0.1, 0.3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, w int, confident boolean, llr double, cycle_s double, takt_s double, slope double")
    got = [r.state for r in runs.predict_states(df, ["k"], "w", detect=1.0, watch=0.5, rising=0.2).orderBy("w").collect()]
    before, want = None, []
    for _, _, conf, llr, cycle, takt, slope in rows:
        if conf and llr >= 1.0:
            now = "ACTIVE" if cycle > takt else "PREDICTED"
        elif llr >= 0.5:
            now = "WATCH"
        elif slope > 0.2:
            now = "DEGRADING"
        elif before in ("WATCH", "PREDICTED", "ACTIVE") and slope < -0.2 or before == "RECOVERING" and slope <= 0:
            now = "RECOVERING"
        else:
            now = "NORMAL"
        want.append(now)
        before = now
    assert got == want


def test_blind_station_sends_nothing(spark):
    tel = fixtures.telemetry(spark, "/root/testdata/sf0.001")
    assert tel.where(F.col("station") == fixtures.BLIND).count() == 0
    assert tel.groupBy("vehicle_id", "station").count().where("count > 1").count() == 0


def test_reachability_of_a_long_line(spark):
    from taktwerk.operators import topology

    edges = spark.createDataFrame([(i, i + 1, 2) for i in range(150)] + [(3, 200, 2), (200, 5, 2)], "src int, dst int, buffer_capacity int")
    got = {(r.src, r.dst) for r in topology.reachable(spark, edges).collect()}
    assert got == {(i, j) for i in range(151) for j in range(i + 1, 151)} | {(i, 200) for i in range(4)} | {(200, j) for j in range(5, 151)}
    assert topology.reachable(spark, edges.where("false")).count() == 0
