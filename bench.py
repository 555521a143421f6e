"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from volspark.plans.session import local_session
from volspark.queries import all_queries

HEADLINE = [
    "region_stats_basic", "region_stats_full", "region_stats_robust", "merged_label_stats", "derived_measures", "label_map_left_zero",
    "region_percentiles", "rescale_and_clip", "border_6", "dilate_26", "box_mean_7_reflect", "gaussian_blur", "components_26",
    "partial_volume_volumes", "agreement_scores", "view_aggregation_argmax", "mode_filter", "nearest_cell_distance", "thick_slices",
    "voxel_weights", "log_error_scan", "command_times", "stage_durations", "stats_regression",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
