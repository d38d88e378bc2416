"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Pass
query names or prefixes to time others.  Every result is computed in full and
discarded at the sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lensmere.plans.registry import registry  # noqa: E402
from lensmere.session import local_session  # noqa: E402

HEADLINE = [
    "term_statistics", "bm25_topk", "dense_topk", "hybrid_topk", "hybrid_rerank", "sq8_recall",
    "scope_classify", "emergency_level", "symptom_entities", "expert_route",
    "expert_evidence_pool", "followup_fold", "memory_text", "token_budget_chunks", "chunk_ids",
    "html_clean", "evidence_block", "document_keywords", "evidence_alignment", "recall_mrr",
    "latency_summary", "session_running_count", "concept_rollup", "cluster_representatives",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    known = registry()
    names = [n for n in known if any(n.startswith(a) for a in sys.argv[1:])] or HEADLINE

    def run(name: str) -> float:
        start = time.time()
        known[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    run("bm25_topk")  # start the JVM's and the Python workers' code paths
    times = {name: round(run(name), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
