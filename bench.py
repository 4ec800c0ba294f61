"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then twice (long ones once); the mean of these counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from wideloom.plans.catalog import QUERIES
from wideloom.session import local_session

HEADLINE = (
    "profile_numeric", "profile_numeric_nulls", "outliers_iqr", "null_profile", "duplicate_rows", "distinct_flags_nulls",
    "categorical_profile", "top_values", "correlated_pairs", "target_correlations", "mi_binned", "quality_issues",
    "clean_impute_median", "clean_impute_mode", "clean_clip_iqr", "clean_dedupe", "clean_by_plan", "cleaning_plan",
    "variance_filter", "anova_f", "f_regression", "encode_label", "encode_frequency", "feat_ratio", "feat_bins", "feat_freq",
    "split_stratified", "cls_metrics", "roc_auc", "class_report", "roc_curve", "reg_metrics", "residual_stats",
    "log_latest", "log_json_filter", "similar_topk", "similar_all", "knn_vote", "ts_resample_users", "ts_lags", "ts_rolling",
    "ts_fold_sizes", "train_logistic",
)


LONG = 4.0  # seconds; longer queries are timed once after the warm-up


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "wideloom-bench", spark__sql__files__openCostInBytes="1048576")
    took: dict[str, float] = {}
    for name in wanted:
        runs = []
        while len(runs) < (3 if not runs or runs[0] < LONG else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.mean(runs[1:]), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
