"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``value`` and ``queries`` are second (warm) runs, as in the last round; ``cold`` has the first ones.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from servelens.plans.queries import QUERIES  # noqa: E402
from servelens.session import get_session, ship_package  # noqa: E402

HEADLINE = (
    "model_scorecard",
    "latency_histogram",
    "histogram_quantile",
    "recent_percentiles",
    "shadow_compare",
    "token_chargeback",
    "top_consumers",
    "match_quota_rule_large_policy",
    "rate_limit",
    "evaluate_access_large_policy",
    "route_least_loaded",
    "scrape_load",
    "load_signal",
    "counter_increase",
    "phase_transitions",
    "proxy_overhead",
    "service_log_round_trip",
    "reconcile_snapshot",
    "allocate_replicas",
    "deployment_status",
    "breaker_transitions",
    "scale_recommendations",
    "drain_verdicts",
    "score_batch",
    "adjudication_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    wanted = sys.argv[1:] or HEADLINE
    cold: dict[str, float] = {}
    seconds: dict[str, float] = {}
    for name in wanted:
        # The first run pays for the code that it compiles; the second does not. Both are reported.
        for times in (cold, seconds):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold_value": round(sum(cold.values()), 3),
                "cold": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
