"""A frozen context: its numbers against numpy, its tables on disk, and runs that do not fit it."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.operators import context as C
from taktwerk.operators.quantiles import exact_medians, exact_quantiles
from taktwerk.operators.windows import WindowSpec

SPEC = WindowSpec(warmup=3)
WINDOWS = "window long, station int, proc_time_s_mean double, blocked_s_mean double, starved_s_mean double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    windows = [(w, s, 30 + s + rng.gauss(0, 1), abs(rng.gauss(3, 1)), abs(rng.gauss(5, 2))) for w in range(40) for s in range(4)] + [(w, 9, 30.0, 0.0, 0.0) for w in range(5)]
    tel = [(v, s, "AB"[v % 2], v % 3 if v % 7 else None, 30 + s + v % 2 + rng.gauss(0, 1)) for v in range(200) for s in (0, 1, 2, 3, 9)]
    mix = [(w, x, 0.5) for w in range(40) for x in "AB"]
    return (spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(tel, "vehicle_id long, station int, variant string, shift int, proc_time_s double"), spark.createDataFrame(mix, "window long, variant string, share double"), spark.createDataFrame([(w, w % 3) for w in range(40)], "window long, shift int"), windows)


def test_centres_scales_and_spreads(tables):
    windows, tel, mix, shift, rows = tables
    ctx = C.fit_baseline(windows, tel, mix, shift, 60.0, SPEC)
    got = {r["station"]: r for r in ctx.stations.collect()}
    scales = {"blocked": [], "starved": []}
    for s in (0, 1, 2, 3, 9):
        for k, c in ((3, "blocked"), (4, "starved")):
            x = np.array([r[k] / 60 for r in rows if r[1] == s])
            scale = 0.015 if len(x) < 8 else max(np.median(abs(x - np.median(x))) * 1.4826, 0.015)
            assert abs(got[s][f"{c}_center"] - np.median(x)) < 1e-9 and abs(got[s][f"{c}_scale"] - scale) < 1e-9
            scales[c].append(scale)
    assert abs(ctx.sigma_blocked - np.median(scales["blocked"])) < 1e-9 and abs(ctx.sigma_starved - np.median(scales["starved"])) < 1e-9
    assert got[9]["proc_scale"] == 0.30  # five windows are too few
    again = C.score(ctx, windows.withColumn("station", F.col("station") + 1), mix, shift)
    assert {r["station"] for r in again.where("d_blocked IS NULL").collect()} == {4, 10}  # not known to the context


def test_tau_equals_numpy(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=60)
    x = np.stack([common + rng.normal(size=60) for _ in range(5)] + [np.zeros(60)])
    rows = [(w, s, float(x[s, w]), 0.0) for w in range(60) for s in range(6)] + [(w, 6, float(w), 0.0) for w in range(59)]  # station 5 never changes, 6 has a gap
    d = spark.createDataFrame(rows, "window long, station int, d_blocked double, d_starved double")
    rho = np.corrcoef(x[:5])[~np.eye(5, dtype=bool)].mean()
    assert abs(C.correlation_share(d) - 1 / (1 + 4 * rho)) < 1e-9
    assert C.correlation_share(d.where("window < 9")) == 1.0 and C.correlation_share(d.where("station < 2")) == 1.0 and C.correlation_share(d.limit(0)) == 1.0


def test_thresholds_are_quantiles_of_the_leaders(spark, tables):
    windows, tel, mix, shift, _ = tables
    ctx = C.fit_baseline(windows, tel, mix, shift, 60.0, SPEC)
    rng = random.Random(3)
    post = [(w, k, rng.gauss(2, 3), p) for w in range(200) for k, p in ((0, 0.1), (1, 0.6 if w % 2 else 0.05), (-1, 0.2))]
    lead = np.array([r[2] for r in post if r[1] == (1 if r[0] % 2 else 0)])
    out = C.thresholds(ctx, spark.createDataFrame(post, "window long, k int, llr_s double, post double"))
    assert abs(out.detect - np.quantile(lead, 0.99)) < 1e-6 and abs(out.watch - min(np.quantile(lead, 0.95), 0.9 * out.detect)) < 1e-6 and abs(out.noise - lead.std()) < 1e-6
    none = C.thresholds(ctx, spark.createDataFrame([], "window long, k int, llr_s double, post double"))
    assert (none.detect, none.watch, none.noise) == (ctx.detect, ctx.watch, ctx.noise)


def test_a_version_is_written_once_and_runs_that_differ_are_refused(spark, tables, tmp_path):
    windows, tel, mix, shift, _ = tables
    root = str(tmp_path / "contexts")
    ctx = replace(C.fit_baseline(windows, tel, mix, shift, 60.0, SPEC), tau=0.4, detect=5.5)
    C.save(ctx, root, "v1")
    back = C.load(spark, root, "v1", takt_s=60.0, spec=SPEC)
    assert back.numbers() == ctx.numbers()
    one, two = (sorted(map(tuple, C.score(c, windows, mix, shift).collect())) for c in (ctx, back))
    assert one == two
    with pytest.raises(Exception, match="exist"):
        C.save(ctx, root, "v1")
    with pytest.raises(ValueError, match="takt_s"):
        C.load(spark, root, "v1", takt_s=55.0, spec=SPEC)
    with pytest.raises(ValueError, match="warmup"):
        C.load(spark, root, "v1", takt_s=60.0, spec=WindowSpec(warmup=4))
    with pytest.raises(LookupError):
        C.load(spark, root, "v2", takt_s=60.0, spec=SPEC)


def test_quantiles_keep_null_groups(spark):
    d = spark.createDataFrame([(None, 1, 1.0), (None, 1, 4.0), ("a", None, 2.0), ("a", 2, None), ("a", 1, 7.0)], "g string, h int, v double")
    assert {(r["g"], r["n"], r["m"]) for r in exact_medians(d, ["g"], "v", "m").collect()} == {(None, 2, 2.5), ("a", 2, 4.5)}
    assert {(r["g"], r["h"], r["q"]) for r in exact_quantiles(d, ["g", "h"], "v", {"q": 1.0}).collect()} == {(None, 1, 4.0), ("a", None, 2.0), ("a", 1, 7.0)}
