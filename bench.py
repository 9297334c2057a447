"""Benchmark the headline queries; prints one JSON line.

one warm-up then the median of 3, output forced with a ``noop`` write. The
landing files and the base load are set up once, untimed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from lakeloom.operators import commit as C  # noqa: E402
from lakeloom.operators.dedup import latest_by_key_window  # noqa: E402
from lakeloom.plans import catalog as Q  # noqa: E402
from lakeloom.plans import staging as STG  # noqa: E402
from lakeloom.plans.ingest import ingest  # noqa: E402
from lakeloom.session import local_session, scratch_dir  # noqa: E402
from lakeloom.sources.landing import ScanScope  # noqa: E402

REPS = int(os.environ.get("BENCH_REPS", "3"))


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, reps=REPS):
    fn()  # warm-up
    times = []
    for _ in range(reps):
        t = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t)
    return statistics.median(times)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):  # stage/task times without the UI
        import tempfile

        extra = {"spark.eventLog.enabled": "true",
                 "spark.eventLog.dir": tempfile.mkdtemp(prefix="run-events-", dir="/tmp")}
        print(f"event log: {extra['spark.eventLog.dir']}", file=sys.stderr)
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)) if cpus.isdigit() else 16,
                          extra_conf=extra)

    t0 = time.perf_counter()
    fx = Q.fixture(spark, sf_dir)  # landing from events + one backfill load
    setup_s = time.perf_counter() - t0
    files = C.committed(spark, fx.warehouse, C.LOAD_LOG).count()
    rows = C.committed(spark, fx.warehouse, C.RAW).count()

    def ingest_raw():
        ingest(spark, Q.SPEC, fx.landing, scratch_dir(spark, "bench-wh"), ScanScope.backfill())

    def ingest_rerun_noop():
        r = ingest(spark, Q.SPEC, fx.landing, fx.warehouse, ScanScope.backfill())
        assert r.batch_id is None  # nothing read: no file body was opened

    raw = C.committed(spark, fx.warehouse, C.RAW)
    typed = STG.typed_events(raw, Q.SPEC)

    queries = {
        "ingest_raw": ingest_raw,
        "ingest_rerun_noop": ingest_rerun_noop,
        "stg_events_latest": lambda: noop(STG.stg_events(raw, Q.SPEC)),
        "stg_events_latest_window": lambda: noop(latest_by_key_window(typed, ["event_id"], list(STG.EVENT_ORDER))),
        "mart_opportunities": lambda: noop(Q.q_mart_opportunities(spark, sf_dir)),
        "masked_reader": lambda: noop(Q.q_masked_reader(spark, sf_dir)),
        "plain_reader": lambda: noop(Q.accounts(spark, sf_dir).select("account_id", "account_name", "arr")),
        "access_audit": lambda: noop(Q.q_access_audit(spark, sf_dir)),
        "dq_checks": lambda: noop(Q.q_dq_checks(spark, sf_dir)),
        "events_by_day": lambda: noop(Q.q_events_by_day(spark, sf_dir)),
    }
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    results = {name: round(timed(fn), 3) for name, fn in queries.items() if not only or name in only}

    headline = ["ingest_raw", "ingest_rerun_noop", "stg_events_latest", "mart_opportunities",
                "masked_reader", "access_audit", "dq_checks", "events_by_day"]
    value = round(sum(results[q] for q in headline if q in results), 3)
    extra = {"setup_sec": round(setup_s, 3), "landing_files": files, "raw_rows": rows}
    if "ingest_raw" in results:
        extra["ingest_rows_per_sec"] = round(rows / results["ingest_raw"], 1)
        extra["ingest_files_per_sec"] = round(files / results["ingest_raw"], 1)
    if "masked_reader" in results and "plain_reader" in results:
        extra["masking_overhead_sec"] = round(results["masked_reader"] - results["plain_reader"], 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": value, "unit": "sec", "queries": results,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
