"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog.all  # noqa: E402,F401
from brightlake.session import local_session  # noqa: E402
from catalog.base import QUERIES  # noqa: E402

HEADLINE = [
    "a6_denormalize", "b8_duplicate_count", "b11_preprocess", "b12_period_filter_recent", "c6_impute_smart", "d1_scale_standard",
    "d5_label_encode", "d8_undersample", "e2_column_profile_numeric", "e5_quality_score", "e9_basic_stats", "e19_text_stats",
    "e20_word_frequencies", "f1_correlation_pearson", "f2_correlation_spearman", "f3_correlation_kendall", "f10_mutual_information",
    "g1_welch_ttest", "g3_chi2_independence", "h4_merge_outer", "h8_merge_chain", "h13_group_summary", "h14_pivot_table", "i3_histogram",
    "i5_box_summary", "j3_resample_day", "j6_decompose_additive", "j8_rolling_stats", "j17_acf", "j29_compare_models", "k6_anomaly_mad_rolling",
    "l2_pca_scores", "l7_kmeans", "l9_cluster_metrics", "l10_dbscan", "m2_linear_regression", "m6_classification_report",
    "n3_kpi_30d_revenue", "n8_user_stats", "n16_cross_sell_pairs", "n22_category_growth", "n32_business_insights_topics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    picked = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in picked:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
