"""Headline queries, median of three warm runs each, one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from holdfast.plans import catalog
from holdfast.session import local_session

HEADLINE = [
    "turn_metric_bundle",
    "condition_table",
    "deduped_records",
    "first_failure_by_category",
    "applicability_final",
    "applicability_turn_rollup",
    "target_failed_rule_matrix",
    "attack_change_table",
    "matched_first_attack",
    "collapse_table",
    "replayed_checkpoints",
    "human_audit_summary",
    "constraint_checks",
    "rule_dispatch_cells",
    "response_condition_table",
    "batch_reply_verdicts",
    "transform_size_changes",
    "sampled_case_matrix",
    "document_token_counts",
    "safety_audit",
    "streamed_score_cells",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, name="holdfast-bench")
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for attempt in range(4):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_median_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
