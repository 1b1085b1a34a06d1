"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Results go to
Spark's noop sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textward.plans.registry import REGISTRY  # noqa: E402
from textward.session import local_session  # noqa: E402

HEADLINE = (
    "actions_by_source", "inspection_results", "entity_spans", "redact_mask", "redact_merged", "vault_restore",
    "policy_decisions_all_rules", "rule_coverage", "poisoning_verdicts", "file_scan_profile", "prompt_firewall",
    "conversation_gateway", "output_firewall", "history_bound", "context_trim", "store_authorization",
    "retrieve_top_k", "tool_call_decisions", "token_bucket", "trailing_counts", "audit_summary", "dashboard_kpis",
    "latency_histogram", "risk_histogram", "stream_action_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(name="bench")
    # Start the Python workers and load the JIT before timing anything.
    REGISTRY["actions_by_source"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    REGISTRY["token_bucket"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
