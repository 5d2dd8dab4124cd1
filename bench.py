"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "causation_edges", "outcome_layer", "category_edges", "chain_violations", "factor_vectors", "chain_transitions", "cooccurrence", "presence_patterns", "dense_edges",
    "backdoor_effect", "do_ranking", "noisy_or_nll", "carb_icing", "violation_rate", "nearest_station", "hour_matched_controls", "auc", "delong_ci", "average_precision", "kendall_tau",
    "semantic_recall", "quality_filter", "normalize_text", "enrich_structured", "dedupe_pipeline", "near_duplicates", "pc_skeleton", "noisy_or_fit",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    from pyspark.sql import SparkSession

    from causaloom.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, taken = catalog.queries(), {}
    found["factor_presence"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": float(scale[1].rstrip(".")) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
