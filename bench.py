"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is
warmed once, then timed ``BENCH_RUNS`` times into a no-op sink; the median counts.
``BENCH_COMPARE=1`` also times, outside the total, the plain forms of two plans.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from geoscore.functions.scores import at_or_above, soft_vote  # noqa: E402
from geoscore.operators import metrics, ranking  # noqa: E402
from geoscore.plans import learners, model  # noqa: E402
from geoscore.workload.queries import QUERIES, QUERY_ROUNDS, VOTES  # noqa: E402
from geoscore.workload.views import view  # noqa: E402

HEADLINE = (
    "band_summary",
    "threshold_curve",
    "precision_recall_fbeta",
    "roc_auc",
    "rank_metrics_by_state",
    "metrics_record",
    "model_comparison",
    "grouped_folds_points",
    "grouped_folds_unbounded",
    "fold_balance",
    "heat_tiles_rollup",
    "dataset_profile",
    "one_hot_encode",
    "json_required_fields",
    "json_typed_quarantine",
    "json_valid_rows",
    "batch_score",
    "scored_heat_layer",
)


def plain_forms(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """One pass per threshold, and ranking in a one-task window."""
    scored = view(spark, sf_dir, "scored").select("label", soft_vote(VOTES).alias("score"))
    timings = {}
    start = time.perf_counter()
    for threshold in metrics.grid_values():
        metrics.confusion(scored, "label", at_or_above("score", threshold)).collect()
    timings["threshold_curve_181_passes"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    ranking.rank_metrics(scored, "score", "label", slices=1).collect()
    timings["roc_auc_one_task"] = round(time.perf_counter() - start, 3)
    return timings


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("geoscore-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings: dict[str, float] = {}
    if not sys.argv[1:]:
        # One fit is a minute of work at most scales: timed once, cold, as it is used.
        start = time.perf_counter()
        rows = view(spark, sf_dir, "observations")
        model.fit(rows, "event_id", [learners.boosted_b(QUERY_ROUNDS)])
        timings[f"boosted_fit_{QUERY_ROUNDS}_rounds"] = round(time.perf_counter() - start, 3)
    for name in names:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
    }
    if os.environ.get("BENCH_COMPARE") == "1":
        result["plain_forms"] = plain_forms(spark, sf_dir)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
