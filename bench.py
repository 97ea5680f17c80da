"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is forced to completion with the no-op sink (every row and
column computed, nothing collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldscope.plans import queries as Q  # noqa: E402
from fieldscope.session import local_session  # noqa: E402

HEADLINE = [
    "compare_variants",      # E1 file level: walk, profile, exact + fuzzy match, null-parent rules
    "compare_by_table",      # E1 with a dict catalog from table metadata
    "field_rollup",          # A4/A5 cross-document roll-up over two catalogs
    "record_conformance",    # J7 per-record compare of multi-record documents
    "validation_details",    # E2 per-document validation verdicts
    "special_char_profile",  # P20/P21 value profiling with line numbers
    "special_char_docs",     # P16 over whole document texts
    "structure_diff",        # X1 full-outer structure diff of document pairs
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    # warm the JVM and the Python workers once (not timed)
    from pyspark.sql import functions as F

    from fieldscope.functions.similarity import sequence_ratio

    spark.range(64).select(F.expr("parse_json(to_json(named_struct('a', id)))").alias("v"),
                           sequence_ratio(F.lit("ab"), F.lit("ac")).alias("r")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
