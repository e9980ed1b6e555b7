"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The reads, scans, expiry, compaction and log queries that exercise one operator family each.
HEADLINE = (
    "live_view", "latest_per_key", "snapshot_asof", "lww_composite", "multi_get", "range_scan", "prev_next", "txn_batch_size", "ttl_live", "ttl_debounce", "wal_segments", "wal_gaps",
    "wal_json", "table_stats", "overlap_tables", "block_index", "manifest_replay", "compaction_invariance", "membership_semi", "membership_anti", "dedup_insert_unique", "cuckoo_probe",
)


def main() -> None:
    from siltstone.plans import registry
    from siltstone.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    with tempfile.TemporaryDirectory() as checkpoints:
        spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "8g"), checkpoints)
        times = {}
        for name in HEADLINE:
            runs = []
            for _ in range(3):
                began = time.perf_counter()
                registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - began)
            times[name] = round(min(runs), 4)
        spark.stop()
    sf = sf_dir.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
