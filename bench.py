"""Benchmark the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Every query is executed in full with the ``noop`` sink (nothing is collected
to the driver); ``value`` is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "precursors",            # flagship: normalise -> clauses -> triggers -> precursors (in-row)
    "precursors_window",     # same result through the generic one-window operator
    "event_precursors",      # window operator on the events table
    "clauses",
    "rules_lexicon",
    "macro_prf",
    "project_labels",
    "cause_distance",
    "clause_embedding",
    "merge_pieces",
    "rules_parse",
    "clauses_from_parse",
    "features",
    "topic_keywords",
    "density_topics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("CLAUSEWISE_MASTER", f"local[{cpus}]")
    os.environ.setdefault("CLAUSEWISE_SHUFFLE_PARTITIONS", str(max(int(cpus), 8)))
    from clausewise.plans.catalog import QUERIES
    from clausewise.session import get_spark

    spark = get_spark()
    # warm-up: JVM, codegen caches and the parquet footer cache (not timed)
    QUERIES["clauses"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
