"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from clearwright.plans.catalog import QUERIES
from clearwright.session import local_session

HEADLINES = (
    "p01_normalized_findings", "j03_resolved_purls", "j05_symbol_identity_hits", "j06_string_identity_hits", "d00_decisions",
    "a06_stage_histogram", "a01_scan_summaries", "a03_coverage_rollup", "a21_vex_audit", "a16_pairing_losses",
    "j18_evidence_pack", "k03_bundle_ids", "k04_openvex_lines", "s01_grype_findings", "s28_osv_findings",
    "j21_lines_in_functions", "a24_artifact_hashes", "f20_symbol_normal_form",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
