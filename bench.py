"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` (a comma list, or ``all``) what to run. Every query runs over
whole tables; rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "url_parse", "url_templates", "endpoint_params", "page_ids", "scrub_tokens", "scrub_text", "redaction_counts", "leak_audit", "asof_click_to_purchase", "next_state_after_call",
    "action_of_download", "dedupe_states", "transitions", "edges_without_pause", "actions_of_states", "calls_to_states", "dependencies", "routes_bfs", "retain_latest", "page_outline", "nav_items",
    "repeats", "menu_merge", "unvisited_menu", "coverage_totals", "props_shape", "order_shapes", "enum_columns", "merged_controls", "bursts", "download_lifecycle",
)


def main() -> None:
    from wayfold.plans import registry
    from wayfold.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    every = registry.queries()
    names = list(every) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "wayfold-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
