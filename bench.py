"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Each query is run to the end through the noop sink; the best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from paneloom.plans import QUERIES
from paneloom.session import build_session

HEADLINE = [
    "panel_status_report",
    "panel_statement_changes",
    "jn7_interval_join",
    "jn8_asof_join",
    "jn11_previous_period",
    "jn13_fuzzy_best_match",
    "wn1_lead_and_lag",
    "wn3_event_type",
    "wn7_fill_forward",
    "wn9_precedence_dedupe",
    "wn10_top_k",
    "ag4_value_counts",
    "ag5_profile",
    "ag6_quantiles",
    "ag11_correlations",
    "fn_m2_ratios",
    "fn_m6_winsorise",
    "tx1_tokenise",
    "tx4_unusable_documents",
    "tx9_category_counts",
    "tx13_term_frequency",
    "tx15_mentions",
    "gr1_undirected_edges",
    "gr5_prune_nodes",
    "gr8_top_neighbours",
    "gr9_similarity_edges",
    "gr12_neighbour_max",
    "tx20_embeddings",
    "ml2_exact_holdout",
    "ml5_elastic_net",
    "ml6_grid_search",
    "ml7_boosted_trees",
    "ml13_class_report",
    "ml20_mcnemar_table",
    "ml22_leaderboard",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the JVM's code paths
    times: dict[str, float] = {}
    for name in chosen:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
