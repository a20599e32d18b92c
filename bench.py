"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) are read
from the environment; BENCH_ONLY limits the run to queries with these prefixes.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402

HEADLINE = [
    "run_quality_board", "a1_performance", "a2_classification_report", "a5_performance_excluding_confused", "a10_agreement_matrix",
    "a12_cohen_kappa", "a13_mcnemar", "m19_agreement_bundle_mcnemar", "a15_vote_metrics", "a22_per_model_metrics", "a24_ece",
    "a40_roc_auc", "a41_spearman", "w2_row_rank_by_group", "w4_quintiles", "w6_robust_z", "a57_token_prior", "w7_prior_stats",
    "j1_compare_runs_wide", "j10_nearest_other_class", "j11_topk_similar", "m13_knn_classify", "f1_stratified_take", "f11_build_seed_vault",
    "f17_fixed_batches", "f18_label_balanced_batches", "n1_corrupt_labels_random", "n8_find_label_issues", "n11_centroid_distance_flag",
    "m2_batch_predict", "m3_parse_label_responses", "m4_parse_multilabel_responses", "m17_evaluate", "s3_write_tier", "s7_read_predictions",
    "m9_tfidf_logreg", "f21_cluster_representatives", "n12_outliers", "n13_near_duplicates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    stages = tempfile.mkdtemp(prefix="spark-")  # one machine: its own folder is shared by all executor threads
    only = tuple(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", stages)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()  # session warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and not name.startswith(only):
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    shutil.rmtree(stages, ignore_errors=True)


if __name__ == "__main__":
    main()
