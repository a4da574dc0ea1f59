"""Wall seconds of the headline jobs; prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from countersign.session import local_session
from countersign.workload import catalogue

HEADLINE = (
    "m3_signoff_decide",
    "m1_workflow_decide",
    "r1_route",
    "c01_ingest_ledger",
    "c02_process_bounces",
    "c05_verify_candidates",
    "j08_document_found",
    "c08_upgrade_proofs",
    "c07_sweep",
    "w6_digest_tree",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="countersign-bench")
    # Start the JVM's pools before the clock runs.
    catalogue.QUERIES["w1_assign_sequence"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
