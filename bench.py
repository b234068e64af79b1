"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginwise import catalog  # noqa: E402
from marginwise.session import build_session  # noqa: E402

# The slowest and most telling queries of each area.
HEADLINE = [
    "scan_numeric_csv",
    "zscore_train",
    "column_summary",
    "gram_matrix",
    "kernel_pairs_train",
    "kernel_pairs_eval",
    "kernel_radius_join",
    "nonzero_count_train",
    "matmul_sparse",
    "score_join",
    "gradient",
    "score_quantile",
    "order_statistics_grid",
    "roc_table",
    "select_instances",
    "kfold_assign",
    "train_svm",
    "sparsity_sweep",
    "select_model",
    "predict",
    "grid_search_cv",
    "final_test_report",
]


def run(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One pass on the small tables starts the JVM code paths and the Python workers.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        run(spark, "kernel_pairs_train", small)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
