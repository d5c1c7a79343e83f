"""What plans keep on disk: settled tables are compact, rows are dealt out once."""

from __future__ import annotations

import re
from urllib.parse import urlparse
from pathlib import Path

from pyspark.sql import functions as F

from taktwerk.functions.lineage import CLEANUP, settled
from taktwerk.operators import windows as W
from taktwerk.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_settled_tables_are_compact(spark):
    before = spark.conf.get(CLEANUP, None)
    rows = spark.range(100_000).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit("variant").alias("v"))
    kept = settled(rows.groupBy("id", "x", "v").count())
    assert kept.columns == ["id", "x", "v", "count"] and kept.count() == 100_000 and kept.agg(F.sum("x")).first()[0] == 450_000.0
    assert 0 < sum(Path(urlparse(f).path).stat().st_size for f in kept.inputFiles()) < 16 * 100_000
    assert spark.conf.get(CLEANUP, None) == before
    assert settled(rows.where("id < 0")).count() == 0


def test_visits_are_shuffled_once(spark):
    plan = X.passes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?:l_orderkey|vehicle_key)#\w+[,)]", plan)) == 1 + len(re.findall(r"Exchange hashpartitioning\((?:o_orderkey|vehicle_key)#\w+, \d+\), ENSURE", plan)), plan


def test_panes_are_summed_before_they_are_shuffled(spark):
    """Windows that cross the border of two blocks of panes equal those from copied rows."""
    d = spark.range(1_500).select(F.col("id").alias("vehicle_id"), (F.col("id") % 2).alias("station"), (F.col("id") * 7 % 101).cast("double").alias("x"))
    spec = W.WindowSpec(width=20, stride=5, warmup=3)
    got = {(r["window"], r["station"]): (round(r["x_mean"], 9), r["x_count"], r["x_max"]) for r in W.window_aggregate(d, spec, ["x"], W.n_vehicles(d)).collect()}
    copied = W.in_windows(d, spec, W.n_vehicles(d)).groupBy("window", "station").agg(F.avg("x").alias("m"), F.count("x").alias("n"), F.max("x").alias("hi"))
    assert got == {(r["window"], r["station"]): (round(r["m"], 9), r["n"], r["hi"]) for r in copied.collect()} and len(got) == 2 * spec.count(1_500)


def test_alerts_project_telemetry_once(spark, monkeypatch):
    """All that an alert rests on is read from one settled table."""
    from taktwerk.plans import decisions

    calls, project = [], X.telemetry
    monkeypatch.setattr(X, "telemetry", lambda *a: calls.append(a) or project(*a))
    assert decisions.alert_table(spark, SF).count() > 0 and len(calls) == 1
