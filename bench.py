"""Headline-query timings.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed in
full with the ``noop`` sink (no driver collect), three times; the best time is
reported, so JVM warm-up and the container's timing noise count less.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsight.plans.queries import QUERIES  # noqa: E402
from tabsight.session import local_session  # noqa: E402

HEADLINE = [
    "truncate_context",
    "route_action",
    "action_doc_join",
    "parse_status",
    "suppress_state",
    "latest_wins",
    "outcome_resolve",
    "outcome_report",
    "reward_labels",
    "dpo_pairs",
    "revision_diff_totals",
    "coalesce_triggers",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="tabsight-bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(3):
            t0 = time.perf_counter()
            QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    sf = os.path.basename(base.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "spark_conf": conf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
