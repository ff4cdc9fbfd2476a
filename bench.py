"""Times the headline queries and prints one JSON line.

Each query runs twice. ``queries`` and ``value`` are the second runs; ``first``
holds the first ones, which also plan, generate code and start Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from tidefold.session import local_session

# ``project_all_columns`` is the projection in full width, ``project_portfolio``
# its digest per path; the others are parts and reports.
HEADLINE = (
    "policy_terms", "fixed", "violations", "end_values", "portfolio_totals",
    "project_portfolio", "project_all_columns",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from checks.queries import projection

    runs = dict(QUERIES, project_all_columns=projection)
    first, times = {}, {}
    for name in HEADLINE:
        for record in (first, times):
            started = time.perf_counter()
            runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - started, 3)
        print(name, first[name], times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first": first,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
