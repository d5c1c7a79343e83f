"""Components of links: stars of a task's links, and few small tasks where there are few links."""

from __future__ import annotations

import random

from taktwerk.llm import graph
from taktwerk.llm.common import Scratch


def _brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _links(n, of):
    rng = random.Random(5)
    return [(a, b) for a, b in ((rng.randrange(-of, of), rng.randrange(-of, of)) for _ in range(n)) if a != b]


def test_few_links_take_few_tasks(spark):
    """Before, each of some nine shuffles a round ran in as many tasks as there are shuffle partitions."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    links = [(i, i + 1) for i in range(200)] + [(1_000, k) for k in range(1_001, 1_100)]
    table = spark.createDataFrame(links, "a long, b long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sc.setJobGroup("components", "")
        got = {r["node"]: r["component"] for r in graph.components(table, Scratch(spark, "t")).collect()}
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("components") for s in sc.statusTracker().getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(sc.statusTracker().getStageInfo, stages) if x)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _brute(links)
    assert tasks < 600, tasks


def test_components_over_many_tasks(spark, monkeypatch):
    """Tasks that hold a few links each leave the rest to the rounds."""
    monkeypatch.setattr(graph, "TASK_LINKS", 16)
    links = _links(300, 200) + [(i, i + 1) for i in range(1_000, 1_120)] + [(7, 7)]
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(8), Scratch(spark, "t"))
    assert {(r["node"], r["component"]) for r in got.collect()} == set(_brute([x for x in links if x[0] != x[1]]).items())
    assert got.count() == got.select("node").distinct().count()
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
