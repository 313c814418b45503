"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "strong_correlations", "corr_matrix", "corr_spearman", "profile_var_types", "profile_numeric_stats", "profile_categorical_stats", "histogram",
    "missing_profile", "impute_mean_median", "scale_standard", "scale_robust", "encode_label", "outlier_iqr", "outlier_isolation_forest", "lag_features",
    "rolling_features", "resample", "seasonal_decompose", "chi2_independence", "ks_two_sample", "regression_test", "hsic_test", "gram_stats", "pc_skeleton",
    "greedy_search", "direct_lingam", "granger_pairwise", "transfer_entropy", "weak_components", "all_simple_paths", "graph_stats", "ate_backdoor",
    "ate_bootstrap", "counterfactual", "chunk_recursive", "vector_topk", "context_pack", "parse_edge_verdicts",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from causalmill.plans import catalogue

    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
