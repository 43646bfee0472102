"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from tidegauge.session import get_spark
from tidegauge.workload import all_queries

HEADLINE = (
    "profile_orders", "numeric_summary", "assigned_roles", "validation_psi", "pearson", "spearman", "outliers", "rfm_segments", "historical_value",
    "abc_bands", "cohort_months", "repeat_behaviour", "association_rules", "campaign_days", "adset_efficiency_rank", "crop_seasons", "yield_collapse",
    "masked_names", "detector_hits", "sentence_bounds", "forecast_scores", "business_findings", "quality_model",
)


def main() -> None:
    # one machine: a folder of its own for checkpoints, gone at the end
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        run(os.environ.get("BENCH_CHECKPOINTS", folder))


def run(checkpoints: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": checkpoints,
    })
    spark.sparkContext.setLogLevel("ERROR")
    available = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        available[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
