"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sentrel.plans.queries import QUERIES  # noqa: E402
from sentrel.session import build_session  # noqa: E402

HEADLINE = (
    "explode_lines",
    "pattern_scan",
    "project_finding",
    "audit_supply_chain",
    "functions_py",
    "functions_structural",
    "code_slice",
    "handler_windows",
    "idor",
    "business_logic_report",
    "taint_flows",
    "stream_severity",
    "audit_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the JVM and the Python workers on the smallest query of each kind.
    for name in ("explode_lines", "functions_py"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    lines = QUERIES["explode_lines"](spark, folder).count()
    audit = seconds.get("audit_report")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "lines": lines,
                "audit_lines_per_sec": round(lines / audit, 1) if audit else None,
            }
        )
    )


if __name__ == "__main__":
    main()
