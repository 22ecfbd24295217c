"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import catalogue
from tessera.session import session

HEADLINE = (
    "flagship_revenue_per_nation", "agg_hash", "agg_cube", "join_inner", "join_full", "join_lateral_top_k", "window_frame_aggregates", "sort_top_k", "set_intersect_all", "ts_bucket_group", "ts_gap_prev", "ca_create", "vector_l2",
    "vector_cosine", "sparse_search", "fts_bm25", "fts_phrase", "hybrid_rrf", "graph_hop", "graph_wcc", "spatial_dwithin", "array_slice", "dml_merge", "board_topk", "temporal_as_of",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    queries["scan_count"](spark, folder).collect()  # start-up isn't counted
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
