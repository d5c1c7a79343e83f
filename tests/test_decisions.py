"""Forecasts of the leading candidate, by hand."""

from __future__ import annotations

from taktwerk.plans import inference
from taktwerk.sources import fixtures as X


def test_forecast_by_hand(spark):
    d = spark.createDataFrame([(0, 75.0), (1, 60.0), (2, 30.0), (3, None)], "window int, cycle_s double")
    got = {r["window"]: r for r in inference.forecast(d).collect()}
    assert got[0]["binding"] and abs(got[0]["loss"] - 0.2) < 1e-12 and abs(got[0]["units_lost"] - 12) < 1e-9
    assert abs(got[0]["minutes_to_starve"] - 5) < 1e-9 and abs(got[0]["minutes_to_block"] - 5) < 1e-9  # half of two places, 12 units an hour
    for w in (1, 2):
        assert not got[w]["binding"] and got[w]["loss"] == 0 and got[w]["units_lost"] == 0 and got[w]["minutes_to_starve"] is None
    assert got[3]["binding"] is None and got[3]["loss"] is None and got[3]["units_lost"] is None


def test_a_window_uses_its_own_candidates_cycle(spark):
    sf = "/root/testdata/sf0.001"
    tops = spark.createDataFrame([(w, s) for w in range(40) for s in (X.BLIND, 0, 5)], "window long, top_station long")
    got = {(r["window"], r["top_station"]): r["cycle_s"] for r in inference.candidate_cycle(spark, sf, tops).collect()}
    assert len(got) == 120
    seen = {(r["window"], r["station"]): r["proc_time_s_mean"] for r in inference.flow.window_table(spark, sf).where("window < 40").collect()}
    hidden = {r["window"]: r["cycle_s"] for r in inference.hidden_cycle_table(spark, sf).collect()}
    for (w, s), c in got.items():
        want = hidden.get(w) if s == X.BLIND else seen.get((w, s))
        assert (c is None) == (want is None) and (c is None or abs(c - want) < 1e-9)
