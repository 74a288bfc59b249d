"""Times the headline queries: one JSON line.

BENCH_SF_DIR is the folder of tables (default sf0.1), BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from probtopk.jobs import fixtures, queries, search  # noqa: E402

HEADLINE = """topk_frames topk_windows difference_detect mixture_cdf column_log_sums expected_confidence cutoff_candidates
window_distribution evaluate_topk non_max_suppression match_detections box_iou_join average_precision apply_oracle
fit_binned_proxy""".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.exact_topk(spark, sf_dir).collect()  # starts the session's workers and compiler
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    mix = fixtures.mixtures(spark, sf_dir, "noisy")
    scores = mix.select("video_id", "frame_id", "score")
    answer = search.topk_frames(scores, mix.select("video_id", "frame_id", "pi", "mu", "sigma"), k=100, num_train=0.04, num_valid=0.01)
    n = scores.count()
    got = sorted((r["score"] for r in answer.topk.collect()), reverse=True)
    exact = [r["score"] for r in queries.topk.exact_topk(scores, 100).collect()]
    quality = {
        "frames": n, "labelled": int(n * 0.04) + int(n * 0.01), "scored_in_rounds": answer.scored, "rounds": answer.rounds,
        "score_error": sum(abs(a - b) for a, b in zip(got, exact, strict=True)) / len(exact),
    }
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir), "topk_frames": quality}))
    spark.stop()


if __name__ == "__main__":
    main()
