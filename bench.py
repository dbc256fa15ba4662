"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from mnemolake import catalog
from mnemolake.session import build_session

HEADLINE = [
    "doc_stats", "term_df", "bm25_topk", "recall_classic", "recall_graph", "cosine_topk", "mrr_recall_at_k",
    "egress_standard", "pii_counts", "router_classify", "concept_bridge", "cooccurrence_pairs", "concept_spread_3hop",
    "hot_concepts", "prune_candidates", "belief_scd2", "as_of_latest", "supersedes_chain", "triples_copula",
    "evidence_chains", "numeric_disputes", "mutual_exclusion", "jaccard_near_dups", "near_copy_groups",
    "consolidate_clusters", "merge_plan", "benchmark_overlap", "log_replay", "checkpoint_diff", "merkle_buckets",
    "delta_missing", "resolve_conflicts", "budget_pack", "streaks", "episodes_sessions", "retention_rules",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "mnemolake.table.parts": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("count(*)").collect()  # JVM warm-up
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
