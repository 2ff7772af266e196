"""Headline queries, timed; prints one JSON line.

One query runs first to warm up the JVM; after that every query is timed once,
planning included. Results are computed in full and go to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers import the library too, from whatever folder this runs in.
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINES = [
    "scan_corpus", "scan_messages", "detect_spans", "sanitize_text", "apply_context_rules",
    "rule_name_phone", "rule_profile_escalation", "dedup_overlaps", "risk_score", "top_detections",
    "threat_report", "process_table", "sanitize_dump", "audit_append", "audit_verify", "admin_view",
    "fpe_encrypt", "pii_records", "redaction_boxes", "dash_user_stats",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from veilspark.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("veilspark-bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("scan_corpus")
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        times[name] = run(name)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
