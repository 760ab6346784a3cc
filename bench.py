"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES a comma list to run instead.
"""

from __future__ import annotations

import json
import os
import time

from gasflow.plans.catalog import QUERIES
from gasflow.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "high_utilization",
    "detect_bottlenecks",
    "flow_direction_changes",
    "vessels_near_locations",
    "pipeline_operations",
    "clean",
    "missing_report",
    "impute_group_median",
    "quantity_bins",
    "fuzzy_match_top1",
    "filter_between",
    "aggregate_sum",
    "aggregate_median",
    "describe_numeric",
    "moments",
    "category_summary",
    "group_stats_by_state",
    "crosstab_state_category",
    "column_profile",
    "infer_column_kind",
    "duplicate_rows",
    "quality_issues",
    "insights",
    "zscore_outliers",
    "iqr_outliers",
    "pearson_matrix",
    "spearman_matrix",
    "anova_f",
    "scale_features",
    "isolation_forest",
    "kmeans_best",
    "dbscan",
    "decode_vessels",
    "vessel_stream_near_locations",
    "simple_query",
    "factor_analysis",
]


def main() -> None:
    spark = local_session(CPUS, "gasflow-bench")
    names = os.environ.get("BENCH_QUERIES")
    seconds: dict[str, float] = {}
    QUERIES["read_table"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
