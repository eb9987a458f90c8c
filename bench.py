"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "graph_edges", "driver_overlap", "ppr_rank", "graph_retrieve", "graph_retrieve_unmasked", "multihop_retrieve",
    "hierarchical_retrieve", "mmr_representatives", "l2_clusters", "cluster_catalog", "cluster_terms", "cosine_topk",
    "bm25_topk", "hybrid_rank", "rerank_topk", "retrieval_metrics", "bleu", "rouge_n", "rouge_l", "dialogue_pairs",
    "call_string", "driver_frequency", "cluster_breakdown", "multi_call_questions", "recent_history", "chat_threads",
]


def main() -> None:
    from callweave.session import build_session, remove_run
    from checks.all_checks import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # One small query first, so that start-up is not counted with the first one.
    spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_mktsegment").count().collect()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    remove_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
