"""Headline queries on one folder of tables; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores;
``BENCH_ONLY`` is an optional comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import time

from pactlake import local_session, release
from pactlake.plans.queries import REGISTERED

HEADLINE = [
    "flagship_publish_report",
    "c7_consume_conformance",
    "b1_decode_envelopes",
    "d1_validate_payloads",
    "d3_infer_path_stats",
    "e3_dedupe_catalog",
    "e6_transitive_referrers",
    "f1_json_schema_diff",
    "f5_compatibility_audit",
    "g1_impact_summary",
    "g8_violation_rollup",
    "h3_violation_flush_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "16g"), cores)
    REGISTERED["a1_read_messages"](spark, folder).count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    release(spark)
    print(json.dumps({"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
