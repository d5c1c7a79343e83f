"""Failed inspections are kept with their vehicles, before their codes are looked up: what finding the vehicles shuffled is gone by then."""

from __future__ import annotations

from taktwerk.functions.lineage import settled
from taktwerk.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_kept_inspections_are_the_failed_ones(spark):
    kept = []
    got = X.inspections(spark, SF, lambda d: kept.append(settled(d)) or kept[-1])
    want = X.inspections(spark, SF).where("result = 'FAIL'")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0
    assert len(kept) == 1 and kept[0].columns == ["vehicle_id", "l_partkey", "l_linestatus"] and kept[0].count() == got.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "o_orderkey" not in plan, plan
