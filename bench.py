"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)

The driver's pages table is one file with one row group; a cluster reads
captured pages from many files.  Before the clock runs, the bench writes the
pages as one file per core into a new scratch folder beside links to the other
tables, so a scan of pages is as many tasks as there are cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

os.environ.setdefault("PYTHONHASHSEED", "0")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagewright.plans.catalog import QUERIES  # noqa: E402
from pagewright.session import local_session  # noqa: E402

HEADLINE = (
    "x_tokens", "x_all_links", "x_link_set", "internal_link_targets", "x_static", "x_title", "x_sitemap",
    "x_robots_rules", "u_canonicalize", "u_local_path", "j_robots_verdict", "j_enqueue", "j_pending_res",
    "j_missing_res", "j_integrity", "a_levels", "a_link_counts", "a_collisions", "a_canon_dups", "a_schedule",
    "a_retry", "a_report", "r_links", "r_static", "r_css", "r_pages", "x_css", "s_mirror", "t_frontier", "t_state",
    "r_typed_pages", "a_next_batch_large",
)


def spread(spark, folder: str, parts: int) -> str:
    """A new folder with the tables of ``folder``, pages written as ``parts`` files."""
    scratch = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(folder):
        if name != "pages.parquet":
            os.symlink(os.path.join(folder, name), os.path.join(scratch, name))
    spark.read.parquet(f"{folder}/pages.parquet").repartition(parts).write.parquet(f"{scratch}/pages.parquet")
    return scratch


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "pagewright-bench")
    source, folder = folder, spread(spark, folder, cores)
    # start the JVM's workers before the clock runs
    n_pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    timings = {}
    for name in names:
        # the first run compiles, so the median of three leaves it out
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "pages_per_second": {n: round(n_pages / s) for n, s in timings.items() if s}, "sf": os.path.basename(source.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
