"""Small cases with known answers for quantiles, the turning point, attribution, decisions and evaluation."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.operators import decide, evaluate, intervals, localise, quality, runs
from taktwerk.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1e6), float(rng.randrange(3))])) for g, n in ((0, 1), (1, 2), (2, 20), (3, 3001)) for _ in range(n)] + [(4, None), (3, None)]
    want = {"a": 0.05, "b": 0.5, "c": 0.995}
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", want).collect()}
    assert set(got) == {0, 1, 2, 3}
    for g in got:
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(x)
        for name, q in want.items():
            assert got[g][name] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-9)


def test_turning_point_names_the_first_starved_station(spark):
    flips = [(0, i, 0.1 if i < 10 else 0.0, 0.0 if i < 10 else 0.1) for i in range(20)]
    none = [(1, i, 0.0, 0.1 * i) for i in range(3)]
    late = [(2, i, 0.2, 0.0) for i in range(3)]
    zero = [(3, 0, 0.2, 0.0), (3, 1, 0.1, 0.1), (3, 2, 0.0, 0.1)]  # the difference passes through 0: no change of sign between neighbours
    one = [(4, 0, 0.2, 0.0)]
    df = spark.createDataFrame(flips + none + late + zero + one, "window int, station int, d_blocked double, d_starved double")
    got = {r.window: (r.station, round(r.strength, 6)) for r in localise.turning_point(df).collect()}
    assert got == {0: (10, 0.2), 1: (0, 0.2), 2: (2, 0.2), 3: (2, 0.2)}


def test_equal_defects_share_one(spark):
    d = spark.createDataFrame([(1, 5, "a", 0.0), (1, 5, "a", 1.0), (2, 5, "a", 0.0), (2, 1, "a", 0.0)], "vehicle_id long, gate_station int, defect_type string, t_found_s double")
    prior = spark.createDataFrame([(1, "a", 0.25), (2, "a", 0.5), (5, "a", 0.25)], "station int, defect_type string, prior double")
    got = quality.attribute(d, prior).groupBy("vehicle_id", "gate_station").agg(F.sum("mass").alias("m")).collect()
    assert {(r.vehicle_id, r.gate_station): round(r.m, 9) for r in got} == {(1, 5): 1.0, (2, 5): 1.0}


def test_state_labels(spark):
    labels = [" Outfeed-Full\t", "BLK", "blocking", "INFEED_EMPTY", "waiting for part", "strv", "Running", "odd"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "s string").select(intervals.state_kind(F.col("s"))).collect()]
    assert got == ["blocked_s"] * 3 + ["starved_s"] * 3 + ["other"] * 2


def test_recommendation_ladder(spark):
    rows = [
        (1, 0.9, 1, True, 0.0, None, True, 9.0, decide.SUPPLY, "ABSTAIN"),
        (1, 0.9, 1, True, 0.0, 0.2, True, 9.0, decide.INSPECT, "INVESTIGATE"),
        (4, 0.9, 1, True, 0.3, 0.2, True, 9.0, decide.SUPPLY, "INVESTIGATE"),
        (4, 0.4, 2, False, 0.0, 0.2, True, 9.0, decide.ESCALATE, "ESCALATE"),
        (4, 0.9, 1, True, 0.0, 0.2, False, 0.0, decide.MONITOR, "WATCH"),
        (4, 0.9, 1, True, 0.0, 0.2, True, 1.0, decide.MONITOR, "WATCH"),
        (4, 0.6, 5, True, 0.0, 0.2, None, None, decide.INSPECT, "INVESTIGATE"),
    ]
    df = spark.createDataFrame([(i, *r[:8]) for i, r in enumerate(rows)], "window int, top_station int, group_prob double, group_size int, confident boolean, p_supply double, upstream_blocked double, binding boolean, units_lost double")
    got = {r.window: r for r in decide.flow_recommendation(df).collect()}
    assert [(got[i].action, got[i].taxonomy) for i in range(len(rows))] == [r[8:] for r in rows]
    assert got[1].priority == "HIGH" and got[6].priority == "MEDIUM" and got[6].n_targets == 3 and got[2].n_targets == 0
    jobs = {r.window: r for r in decide.work_orders(decide.flow_recommendation(df)).collect()}
    assert set(jobs) == {0, 1, 2, 3, 6} and jobs[0].respond_min == 240 and jobs[1].respond_min == 15 and jobs[1].escalate_to == "Process engineer"


def test_ledger_chain_shows_the_first_altered_entry(spark):
    rows = spark.createDataFrame([(c, i, f"body {c} {i}") for c in (1, 2) for i in range(4)], "chain int, entry_id long, body string")
    d = decide.chained(rows, ["chain"], "entry_id", "body", "0")
    altered = d.withColumn("body", F.when((F.col("chain") == 2) & (F.col("entry_id") == 2), "other").otherwise(F.col("body")))
    bad = {(r.chain, r.entry_id) for r in runs.hash_chain_breaks(altered, F.col("body"), "0").where("NOT (linked AND intact)").collect()}
    assert bad == {(2, 2)}


def test_first_sustained_over_block_borders(spark):
    below = [k in range(90, 130) or k in range(10, 20) for k in range(200)]
    df = spark.createDataFrame([(k, float(k), b) for k, b in enumerate(below)], "pos long, t_depart_s double, below boolean")
    assert runs.first_sustained(df, 25, block=100).first()[0] == 114.0
    assert runs.first_sustained(df.where("pos < 60"), 25, block=100).first()[0] is None


def test_early_warning_and_onset(spark):
    truth = spark.createDataFrame([(0, 3, True, "SLOWDOWN", 1000.0, 5000.0, 100.0, 1.5, False, None), (1, None, False, None, None, None, None, None, False, None)], "episode int, station int, has_fault boolean, kind string, t_start_s double, t_end_s double, ramp_s double, magnitude double, source_is_hidden boolean, board_moment_s double")
    cycles = spark.createDataFrame([(3, 50.0)], "station int, base_cycle_s double")
    truth = evaluate.true_onset(truth, cycles, 60.0)
    assert truth.where("episode = 0").first()["onset_s"] == pytest.approx(1000 + 0.4 * 100)
    pred = spark.createDataFrame([(0, 6, "WATCH", 800.0), (1, 2, "WATCH", 980.0), (2, 3, "NORMAL", 900.0)], "window int, station int, state string, t_mid_s double")
    got = {r.episode: r for r in evaluate.early_warning(pred, truth).collect()}
    assert got[0].missed == 0 and got[0].lead_time_min == pytest.approx(1.0) and got[0].lead_time_any_min == pytest.approx(4.0)
    assert got[1].false_alarm == 1.0 and got[1].n_false_alarm_windows == 2
