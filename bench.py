"""Wall-clock seconds of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Every query runs twice and the faster
run counts. The shared tables (vectors, baseline runs, judgments) are derived first and timed on
their own, since every later stage reads them from storage.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks import registry, tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "text_normalize", "doc_offsets", "hash_encode", "centroid", "l2_normalize", "vector_lookup",
    "baseline_topk", "baseline_topk_blocks", "dialogue_topk",
    "prf_importance", "eclipse_importance", "oracular_importance", "answer_importance",
    "top_alpha_mask", "rdime_mask", "masked_search", "alpha_sweep", "rdime_search", "eclipse_sweep",
    "dialogue_answer_sweep", "eval_all", "sweep_eval", "sweep_summary_table", "results_with_retained",
    "graded_qrels", "eval_run", "trial_grid", "run_file",
)


def drain(df) -> None:
    """Compute every row without bringing any to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.time()
    action()
    return time.time() - started


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("dimsift-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="dimsift-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = tables.Tables(spark, SF_DIR)
    seconds = {}
    drain(spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(1))
    for collection in tables.COLLECTIONS:
        seconds[f"build_{collection}"] = timed(lambda: (t.run(collection), t.qrels(collection)))
    for name in sys.argv[1:] or HEADLINE:
        run = registry.QUERIES[name]
        seconds[name] = min(timed(lambda: drain(run(spark, SF_DIR))) for _ in range(2))
        print(f"{name}: {seconds[name]:.2f}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
