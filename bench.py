"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from taktwerk import catalogue

HEADLINE = ("telemetry_projection", "window_aggregate", "takt_deviation", "turning_point", "interval_overlap", "asof_forward", "expected_proc", "z_proc", "spc", "detection_rule", "ewma_llr", "incidents", "hidden_cycle", "hypothesis_llr")
#: Timed as well, but not in the total, so that it stays comparable.
MORE = ("shadow", "predict_state", "quality_state", "defect_risk", "localisation_metrics", "infer", "isolation_forest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    available, times = catalogue.queries(), {}
    available["telemetry_projection"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE + MORE:
        if name in available:
            began = time.time()
            available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.get(n, 0.0) for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
