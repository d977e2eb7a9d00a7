"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores and
``BENCH_RUNS`` the timed runs after one warm-up (median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from wardlake.plans.queries import QUERIES
from wardlake.session import build_session

HEADLINE = (
    "w1_threshold_alerts",
    "w1_threshold_ties",
    "w2_threshold_keys",
    "f7_single_event_match",
    "j1_first_match",
    "j2_all_matches",
    "j3_threat_hits",
    "j3_threat_hits_documents",
    "j4_knowledge",
    "j5_port_catalogue",
    "j8_packet_reputation",
    "a4_timeline",
    "a5_risk_distribution",
    "a6_traffic_counts",
    "a7_active_ips",
    "k1_newest_logs",
    "k2_top_talkers",
    "q4_all_filters",
    "e3_parse_answers",
    "e6_block_list",
    "e8_system_digest",
    "e9_process_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
