"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "risk_summary", "mondrian_sweep", "mondrian_random", "generalize_mean", "risk_enhanced", "prepare_features", "stratified_split",
    "impute_median", "metric_auc", "metric_classification", "gnb_scores", "dp_gnb_scores", "dp_lr", "dp_forest", "quantized_score",
    "mia_table", "smote", "label_encode", "cost_report", "best_tradeoff_cls", "dedup_rows", "lr_scores",
)


def main() -> None:
    from hushframe.session import get_spark, local_checkpoint_dir
    from workload import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    local_checkpoint_dir(spark, os.path.join(tempfile.gettempdir(), "hushframe-checkpoint"))
    spark.sparkContext.setLogLevel("ERROR")
    # JVM start-up and first code generation are not charged to the first query
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    catalog.QUERIES["risk_summary"](spark, small if os.path.isdir(small) else sf).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
