"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
``python bench.py name ...`` times other registered queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from slidegrid.queries import REGISTRY
from slidegrid.session import build_session

HEADLINE = [
    "patient_report", "label_resolution", "slide_assembly", "token_resolution", "patient_merge", "file_reconciliation",
    "hotspot_distribution", "group_medians", "mutation_burden", "co_mutated_genes",
    "overlapping_grid", "cell_coverage", "integral_coverage", "seeded_cap", "accept_until", "heat_grid",
    "tile_statistics", "otsu_threshold", "percentile_scaling", "colour_transfer", "stencil_median", "large_objects", "stain_normalisation",
    "patient_folds", "out_of_fold_scores", "model_auc", "operating_threshold", "bootstrap_intervals",
    "extreme_tiles", "tile_probabilities", "slide_probabilities", "codeword_assignment", "bag_attention",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/nation.parquet").count()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        REGISTRY[name].run(spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(root.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
