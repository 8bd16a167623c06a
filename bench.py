"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the
input and the local cores. Query names as arguments override the headline list. All
queries run once untimed, so that JVM compilation is not counted, and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "transition_rates_by_checkpoint", "transition_funnel", "matched_contrasts", "event_concentration",
    "checkpoint_parent_join", "checkpoint_accounting", "plan_reconciliation", "missing_receipts",
    "availability_by_position", "final_accuracy", "stage_evaluation_counts_forced",
    "generation_performance_forced", "numeric_distribution_forced", "length_distribution",
    "runtime_mean_median", "eligibility_summary_forced", "operational_summary", "intent_states",
    "intent_receipt_recovery", "selection_manifest", "verify_manifest", "content_hashes",
    "fixed_checkpoints", "forced_input", "extract_boxed", "evaluate_answers", "append_once",
    "receipt_batch_digest", "read_eligibility", "stream_receipt_counts", "analysis_report",
)


def main(names: list[str]) -> None:
    import suite.all  # noqa: F401
    from suite.registry import QUERIES
    from trailmark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    timings = {}

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in names or HEADLINE:
        run(name)
    for name in names or HEADLINE:
        started = time.perf_counter()
        run(name)
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{timings[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
