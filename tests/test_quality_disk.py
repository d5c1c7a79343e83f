"""The quality path: inspections are projected once, pools and rates come from panes, the grid of multipliers is never shuffled."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from taktwerk.operators import quality as K
from taktwerk.plans import risk
from taktwerk.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def _defects(spark):
    """1,000 vehicles with 0 to 2 defects of a kind, some found at a second gate, some equal."""
    d = spark.range(3_000).select((F.col("id") % 1_000).alias("vehicle_id"), F.when(F.col("id") % 11 == 0, 5).otherwise(6).alias("gate_station"), F.format_string("Brand#%02d", F.col("id") * F.col("id") % 3).alias("defect_type"))
    return d.where("vehicle_id % 4 <> 1")


@pytest.mark.parametrize("query", ["quality_state", "quality_ranking", "quality_recommendation"])
def test_inspections_are_projected_once(spark, monkeypatch, query):
    calls, project = [], X.inspections
    monkeypatch.setattr(X, "inspections", lambda *a: calls.append(a) or project(*a))
    assert risk.QUERIES[query](spark, SF).count() > 0 and len(calls) == 1


def test_grid_is_not_shuffled(spark):
    counts = spark.createDataFrame([(w, t, 200, (w * 7 + k) % 30) for w in range(50) for k, t in enumerate("abc")], "window long, defect_type string, n int, o long")
    expected = spark.createDataFrame([(s, t, 0.01 * (s + 1)) for s in range(4) for t in "abc"], "station int, defect_type string, m double")
    d = K.poisson_profile(counts, expected)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(window#\d+L, \d+\), REPARTITION_BY_NUM", plan), plan
    assert not re.search(r"Exchange hashpartitioning\(window#\d+L, station", plan), plan
    assert d.count() == 50 * 4


def test_pools_overlap(spark):
    d = _defects(spark)
    windows = spark.range(0, 19).select(F.col("id").alias("window"), ((F.col("id") + 1) * 50).alias("v_end"))
    got = {(r["window"], r["defect_type"]): (r["n"], r["o"]) for r in K.pooled_counts(K.pane_counts(d, 50), windows, 150, 100, 50).collect()}
    rows = [(r["vehicle_id"], r["defect_type"]) for r in d.collect()]
    want = {}
    for w in range(19):
        hi = (w + 1) * 50
        lo = max(0, hi - 150)
        if hi - lo >= 100:
            want |= {(w, t): (hi - lo, sum(lo <= v < hi and k == t for v, k in rows)) for t in {k for _, k in rows}}
    assert got == want
    with pytest.raises(ValueError):
        K.pooled_counts(K.pane_counts(d, 40), windows, 150, 100, 40)


def test_mass_of_panes_is_that_of_defects(spark):
    d = _defects(spark)
    prior = spark.createDataFrame([(s, t, 0.1 * (s + 1)) for s in range(6) for t in ("Brand#00", "Brand#01")], "station int, defect_type string, prior double")
    sums = lambda a: {(r["gate_station"], r["defect_type"], r["station"]): round(r["m"], 9) for r in a.groupBy("gate_station", "defect_type", "station").agg(F.sum("mass").alias("m")).collect()}
    got = sums(K.pane_mass(K.pane_counts(d, 200), prior))
    assert got == sums(K.attribute(d, prior)) and len(got) > 10


def test_no_pool_without_its_vehicles(spark, monkeypatch):
    monkeypatch.setattr(X, "table", lambda s, sf, name: s.read.parquet(f"{sf}/{name}.parquet").limit(risk.STEP - 1))
    assert risk._pools(spark, SF).count() == 0
