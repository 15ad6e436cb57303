"""Benchmark: run every catalogue question at one scale factor and time it.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is forced with a `noop` write (full evaluation, nothing collected).
One untimed warm-up pass over every query comes first (JIT and code generation),
then each query is timed; with BENCH_REPEAT=n the median of n runs is reported.
Prints one JSON line on stdout. `python bench.py --table` instead prints a
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.catalogue import QUERIES  # noqa: E402
from quarry.session import build_session  # noqa: E402


def _run(spark, fn, base: str) -> float:
    spark.catalog.clearCache()  # no query may profit from another query's cached data
    t0 = time.perf_counter()
    fn(spark, base).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app="quarry-bench")
    names = only or list(QUERIES)
    errors = {}
    if os.environ.get("BENCH_WARMUP", "1") != "0":
        for n in names:
            try:
                _run(spark, QUERIES[n], base)
            except Exception as e:  # reported below, the other queries still run
                errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    times = {}
    for n in names:
        if n in errors:
            continue
        try:
            times[n] = round(statistics.median(_run(spark, QUERIES[n], base) for _ in range(repeat)), 3)
        except Exception as e:
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", base)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "n_queries": len(times),
        "cpus": cpus,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    if "--table" in sys.argv:
        _table(spark, base, times)
    spark.stop()


def _table(spark, base: str, times: dict) -> None:
    import contextlib
    import io

    for n, sec in times.items():
        df = QUERIES[n](spark, base)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", buf.getvalue()))
        print(f"| {n} | {sec:.2f} | {df.count()} | {shuffles} |", file=sys.stderr)


if __name__ == "__main__":
    main()
