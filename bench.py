"""Warm wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from agoradesk.plans import registry
from agoradesk.session import build_session

HEADLINE = (
    "user_dashboard", "active_devices", "access_states", "document_list", "request_log_summary", "hourly_request_limits", "sliding_message_limit",
    "reaction_toggles", "document_versions", "operation_replays", "chunk_pipeline_stats", "document_passages", "vector_search", "packed_context",
    "question_intents", "question_facts", "rule_answers", "answer_audit", "integrity_summary", "rule_confirmations", "upserted_passages", "items_for_profiles",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    registry.QUERIES["filtered_event_counts"][0](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
