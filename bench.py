"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from diffloom.plans import all_queries, registry  # noqa: E402
from diffloom.session import drop_cuts, local_session  # noqa: E402

HEADLINES = [
    "j1_diff_row_snapshots",  # changed files
    "j3_pair_renames",  # renames among them
    "j2_diff_trees",  # content-addressed trees
    "t5_resolve_specs",  # rev-parse over all repositories
    "s14_stale_files",  # head against working tree
    "s2_decode_blobs",  # blob reading
    "h1_change_report",  # the flagship: line diffs of every change set
    "w1_align_lines",
    "h2_checked_moves",
    "x1_lww_viewed",  # marks merged
    "u5_merge_base",
    "j14_without_rivals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up of the session is no query's time
    seconds, rows = {}, {}
    for name in HEADLINES:
        registry.forget()  # every query starts from the given tables
        start = time.time()
        # Every column of every row is computed, as a sink would ask for it; count() would let Spark prune them.
        result, seen = queries[name](spark, folder), Observation(name)
        result.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        rows[name] = seen.get["rows"]
        registry.forget()
        drop_cuts(spark)
    total = round(sum(seconds.values()), 3)
    rate = {
        "changed_rows_per_sec": round(rows["j1_diff_row_snapshots"] / seconds["j1_diff_row_snapshots"], 1),
        "lines_aligned_per_sec": round(rows["w1_align_lines"] / seconds["w1_align_lines"], 1),
        "moves_checked_per_sec": round(rows["h2_checked_moves"] / seconds["h2_checked_moves"], 1),
    }
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "rows": rows, "rates": rate, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
