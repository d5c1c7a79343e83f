"""The flow path: telemetry is projected once a query and kept without what follows from it."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import functions as F

from taktwerk.operators import localise as L
from taktwerk.operators import windows as W
from taktwerk.plans import evaluation, flow, inference, streams
from taktwerk.sources import fixtures as X
from taktwerk.streaming import windows as S

SF = "/root/testdata/sf0.001"


def _counted(monkeypatch):
    calls, project = [], X.telemetry
    monkeypatch.setattr(X, "telemetry", lambda *a: calls.append(a) or project(*a))
    return calls


def test_curve_projects_telemetry_once(spark, monkeypatch):
    calls = _counted(monkeypatch)
    assert evaluation.operating_curve(spark, SF).count() > 0 and len(calls) == 1


def test_departures_are_not_kept_on_disk(spark):
    kept, whole = flow.telemetry_table(spark, SF), X.telemetry(spark, SF)
    assert kept.columns == whole.columns and kept.count() == whole.count()
    assert kept.exceptAll(whole).count() == 0
    assert "t_depart_s" not in spark.read.parquet(*kept.inputFiles()).columns


def test_one_line_has_one_store(spark, monkeypatch, tmp_path):
    before, calls = spark.conf.get(S.PARTITIONS), _counted(monkeypatch)
    monkeypatch.setattr(S, "new_root", lambda s, name: f"{tmp_path}/{name}")
    assert streams.stream_tops(spark, SF).count() > 0 and len(calls) == 1
    assert [p.name for p in Path(tmp_path, "tops/checkpoint/state/0").iterdir() if p.name.isdigit()] == ["0"]
    assert spark.conf.get(S.PARTITIONS) == before != "1"


def test_hypotheses_are_not_shuffled(spark):
    d = spark.range(7 * 40).select((F.col("id") / 7).cast("long").alias("window"), (F.col("id") % 7).cast("int").alias("station"), (F.col("id") % 5 / 100).alias("d_blocked"), (F.col("id") % 3 / 100).alias("d_starved"), F.lit(0.5).alias("z_proc"))
    s = L.llr(L.hypothesis_scores(d.where("station <> 3"), inference._prop(spark, SF), 0.03, 0.05, 0.5))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and not re.search(r"Exchange hashpartitioning\(window#\d+L, k", plan), plan
    rows = s.collect()
    assert len(rows) == 40 * 9 and all(r["llr"] == 0 for r in rows if r["k"] == L.NULL)


def test_counts_by_pane_are_those_of_copied_rows(spark):
    d = spark.range(700).select(F.col("id").alias("vehicle_id"), F.when(F.col("id") % 13 > 0, F.col("id") * F.col("id") % 4).alias("variant"))
    total = W.n_vehicles(d)
    for spec in (W.WindowSpec(width=20, stride=5, warmup=3), W.WindowSpec(width=20, stride=6, warmup=3)):
        copied = W.in_windows(d, spec, total).groupBy("window", "variant").agg(F.count(F.lit(1)).alias("n"))
        got = W.window_counts(d, spec, "variant", total)
        assert got.exceptAll(copied).count() == 0 and got.count() == copied.count() > 0
