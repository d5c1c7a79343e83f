"""Isolation forests against a recursive walk, on odd rows and on planted outliers."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.operators import forest as FO
from taktwerk.plans import methods

SPEC = FO.ForestSpec(trees=40, pool=300, sample=64, least=30, seed=3)
XS = ["a", "b"]


def walk(nodes, row, n=1):
    feature, cut, path = nodes[n]
    return path if feature < 0 else walk(nodes, row, 2 * n + (row[feature] >= cut))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [("x", i, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(500)] + [("y", i, rng.gauss(3, 1), 7.0) for i in range(80)] + [("few", i, 1.0, float(i)) for i in range(20)]
    return out + [("x", 900, 9.0, 30.0), ("x", 901, None, 1.0), ("x", 902, float("nan"), 1.0), ("x", 903, float("inf"), 1.0), ("x", 904, 0.0, 5.0), ("y", 905, 3.0, 99.0), (None, 906, 1.0, 1.0)]


def test_scores_equal_a_recursive_walk_and_find_what_was_planted(spark, rows):
    df = spark.createDataFrame(rows, "key string, id long, a double, b double")
    nominal = df.where("id < 900")
    forest = FO.fit_forest(nominal, "key", "id", XS, SPEC)
    table = forest.toPandas()
    assert set(table["key"]) == {"x", "y"} and set(table["sampled"]) == {64}
    trees = {k: {int(r.node): (int(r.feature), r.cut, r.path) for r in g.itertuples()} for k, g in table.groupby(["key", "tree"])}
    assert len(trees) == 2 * SPEC.trees and max(len(t) for t in trees.values()) <= 2 * SPEC.sample
    for block in (50_000, 37):
        got = {(r["key"], r["id"]): r["anomaly"] for r in FO.anomaly_scores(df, forest, "key", "id", XS, SPEC, block).collect()}
        assert len(got) == 583  # none for rows that lack a feature or whose key has no forest
        for (k, i, *x) in rows[::23] + rows[-7:-6] + rows[-3:-1]:
            if (k, i) in got:
                mean = np.mean([walk(trees[k, t], x) for t in range(SPEC.trees)])
                assert abs(got[k, i] - 2 ** (-mean / FO.expected_path(64))) < 1e-9
    assert max((v, i) for (k, i), v in got.items() if k == "x")[1] == 900 and got["x", 900] > 0.62 > got["x", 904]


def test_forests_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(rows, "key string, id long, a double, b double")
    one, two = (FO.fit_forest(d, "key", "id", XS, SPEC).orderBy("key", "tree", "node").toPandas() for d in (df.coalesce(1), df.repartition(5, "id")))
    assert one.equals(two)
    assert FO.fit_forest(df.limit(0), "key", "id", XS, SPEC).count() == 0
    assert FO.anomaly_scores(df.limit(0), FO.fit_forest(df, "key", "id", XS, SPEC), "key", "id", XS, SPEC).count() == 0


def test_equal_rows_make_a_leaf():
    assert FO.grow(np.zeros((9, 2)), "n", 6) == [(1, -1, 0.0, FO.expected_path(9))]
    assert FO.expected_path(1) == 0 and FO.expected_path(2) == 1 and abs(FO.expected_path(256) - 10.244) < 1e-3


def test_trees_draw_from_all_rows_of_a_key(spark):
    """Against plain lists: 3,000 rows of which a pool would leave out two thirds, a key of fewer rows than a tree takes, one of too few, and a missing key."""
    sizes = {"many": 3000, "some": 50, "few": 20, None: 40}
    df = spark.createDataFrame([(k, i, float(i), float(i % 7)) for k, n in sizes.items() for i in range(n)], "key string, id long, a double, b double")
    spec = FO.ForestSpec(trees=40, pool=None, sample=64, least=30, seed=3)
    number = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
    want = set()
    for k in ("many", "some"):
        n, order = sizes[k], sorted(range(sizes[k]), key=lambda i: (number(f"{k}:{i}"), i))
        m = min(n, spec.sample)
        for t in range(spec.trees):
            for j in range(m):
                lo, hi = n * j // m, n * (j + 1) // m
                want.add((k, t, n, order[lo + number(f"{spec.seed}:{k}:{t}:row:{j}") % (hi - lo)]))
    drawn = [tuple(r)[:4] for r in FO.draw_from_all(df.repartition(3), "key", "id", XS, spec).collect()]
    assert len(drawn) == 40 * (64 + 50) and set(drawn) == want
    assert len({i for k, _, _, i in drawn if k == "many"}) > 1500  # 2,560 draws: some 1,720 of 3,000 rows
    forest = FO.fit_forest(df, "key", "id", XS, spec).toPandas()
    assert forest.groupby("key")["sampled"].unique().map(list).to_dict() == {"many": [64], "some": [50]}


def test_all_methods_fit_forests_on_all_nominal_windows(spark, monkeypatch):
    specs, fit = [], FO.fit_forest
    monkeypatch.setattr(FO, "fit_forest", lambda *a: specs.append(a[-1]) or fit(*a))
    assert methods.all_methods(spark, "/root/testdata/sf0.001").where("method = 'isolation_forest'").count() > 0
    assert [s.pool for s in specs] == [None] and "rn <= 1024" not in methods.SQL["all_methods"]
