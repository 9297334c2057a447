"""Command line: the loader and the other jobs, run with spark-submit or python.

    python -m lakeloom ingest --env DEV --root <shared root> --warehouse <wh> [--backfill | --prefill D | --path P]
    python -m lakeloom stream --landing <p> --warehouse <wh> --checkpoint <ckpt> [--available-now | --every '1 minute']
    python -m lakeloom check-config
    python -m lakeloom build --accounts <p> --opportunities <p> --target-root <root> [--sandbox NAME]
    python -m lakeloom masked-read --path <p> --table SCHEMA.TABLE --role ROLE
    python -m lakeloom audit --access-history <p> --query-history <p> --object '%SCHEMA.TABLE' --column ARR [--out <folder>]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session(args) -> SparkSession:
    if args.local:
        from lakeloom.session import local_session

        return local_session()
    return SparkSession.builder.appName("lakeloom").getOrCreate()


def cmd_ingest(args) -> int:
    from lakeloom.config import EVENTS
    from lakeloom.plans.ingest import ingest
    from lakeloom.sources.landing import resolve_scope

    spark = _session(args)
    spec = EVENTS[args.event]
    scope = resolve_scope(path=args.path, backfill=args.backfill, prefill=args.prefill,
                          lookback_hours=args.lookback_hours or spec.lookback_hours)
    landing = args.landing or spec.landing_root(args.root, args.env)
    print(f"scope: {scope.mode}; files in the load log are " + ("loaded again" if args.force_insert else "left out"))
    res = ingest(spark, spec, landing, args.warehouse, scope, force=args.force_insert,
                 strict=args.strict, dry_run=args.dry_run, persist_report=True)
    by_status = {r.status: r["count"] for r in res.report.groupBy("status").count().collect()}
    for status, n in sorted(by_status.items()):
        print(f"{n} file(s) {status}")
    for r in res.report.where("status = 'failed'").orderBy("file_name").toLocalIterator():
        print(f"failed: {r.file_name}: {r.detail}", file=sys.stderr)
    t = res.totals().first()
    print(f"rows: {t.rows_loaded} written, of which {t.rows_quarantined} break the contract")
    return 1 if by_status.get("failed") else 0


def cmd_stream(args) -> int:
    from lakeloom.config import EVENTS
    from lakeloom.plans.ingest import retry_failed
    from lakeloom.streaming.file_arrival import failed_files, ingest_stream, run_available_now, run_stream

    spark = _session(args)
    spec = EVENTS[args.event]
    landing = args.landing or spec.landing_root(args.root, args.env)
    options = {"max_files_per_trigger": args.max_files_per_trigger, "staging": args.staging}
    if args.available_now:
        run_available_now(spark, spec, landing, args.warehouse, args.checkpoint, **options)
    else:
        retry_failed(spark, spec, landing, args.warehouse)
        run_stream(ingest_stream(spark, spec, landing, args.warehouse, args.checkpoint, available_now=False,
                                 processing_time=args.every, retry=True, **options))
    failed = failed_files(spark, args.warehouse)
    n = failed.count()
    for r in failed.orderBy("file_name").limit(20).collect():
        print(f"failed: {r.file_name}")
    print(f"{n} file(s) failed")
    return 1 if n else 0


def cmd_check_config(args) -> int:
    from lakeloom.operators.config_rules import config_violations
    from lakeloom.sources.settings import CONF_DIR, Governance

    spark = _session(args)
    bad = config_violations(Governance.load(spark, args.config or CONF_DIR)).collect()
    for r in bad:
        print(f"{r.table}[{r.key}] {r.rule}: {r.message}")
    print(f"{len(bad)} violation(s)")
    return 1 if bad else 0


def cmd_build(args) -> int:
    from lakeloom.config import Target
    from lakeloom.plans.build import build_sales_models
    from lakeloom.plans.catalog import model_checks
    from lakeloom.sources.cdc import ACCOUNT_CONTRACT, OPPORTUNITY_CONTRACT, read_cdc

    spark = _session(args)
    acc = read_cdc(spark, args.accounts, ACCOUNT_CONTRACT)
    opp = read_cdc(spark, args.opportunities, OPPORTUNITY_CONTRACT)
    target = Target(args.target_root, sandbox=args.sandbox)
    summary = build_sales_models(spark, acc, opp, target, model_checks())
    for r in summary.orderBy("check_name").collect():
        print(f"{r.status.upper():5s} {r.check_name} failures={r.failures}")
    return 0


def cmd_masked_read(args) -> int:
    from lakeloom.operators.governance import masked
    from lakeloom.sources.settings import CONF_DIR, Governance

    spark = _session(args)
    gov = Governance.load(spark, args.config or CONF_DIR)
    return _show(masked(spark, spark.read.parquet(args.path), args.table, args.role, gov), args)


def cmd_audit(args) -> int:
    from lakeloom.operators.audit import column_access

    spark = _session(args)
    ah = spark.read.parquet(args.access_history)
    qh = spark.read.parquet(args.query_history)
    return _show(column_access(ah, qh, args.object, args.column), args)


def _show(df, args) -> int:
    """Write the whole result to ``--out``, or print it; only ``--limit`` cuts it."""
    if args.limit is not None:
        df = df.limit(args.limit)
    if args.out:
        df.write.parquet(args.out)
    else:
        for r in df.toLocalIterator():
            print(json.dumps(r.asDict(), default=str))
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lakeloom")
    ap.add_argument("--local", action="store_true", help="run on a local session")
    sub = ap.add_subparsers(dest="cmd", required=True)

    ing = sub.add_parser("ingest", help="load landing files into RAW + quarantine + load log")
    ing.add_argument("--env", default="DEV", choices=["DEV", "QA", "PROD"])
    ing.add_argument("--event", default="page_views")
    ing.add_argument("--root", default="", help="shared landing root ({env} template base)")
    ing.add_argument("--landing", help="landing folder (overrides --root/--env)")
    ing.add_argument("--warehouse", required=True)
    ing.add_argument("--lookback-hours", type=int)
    ing.add_argument("--prefill", metavar="YYYY-MM-DD")
    ing.add_argument("--backfill", action="store_true")
    ing.add_argument("--path", metavar="dt=YYYY-MM-DD/hr=HH")
    ing.add_argument("--force-insert", action="store_true")
    ing.add_argument("--strict", action="store_true", help="fail the run on any failed file")
    ing.add_argument("--dry-run", action="store_true")
    ing.set_defaults(fn=cmd_ingest)

    stm = sub.add_parser("stream", help="file-arrival ingest with Structured Streaming")
    stm.add_argument("--env", default="DEV", choices=["DEV", "QA", "PROD"])
    stm.add_argument("--event", default="page_views")
    stm.add_argument("--root", default="")
    stm.add_argument("--landing")
    stm.add_argument("--warehouse", required=True)
    stm.add_argument("--checkpoint", required=True, help="streaming checkpoint folder (shared storage)")
    stm.add_argument("--available-now", action="store_true", help="drain what is there, then stop")
    stm.add_argument("--every", default="1 minute", help="processing-time trigger interval")
    stm.add_argument("--max-files-per-trigger", type=int, default=1000)
    stm.add_argument("--staging", help="snapshot folder of the deduplicated events, kept up to date by the stream")
    stm.set_defaults(fn=cmd_stream)

    chk = sub.add_parser("check-config", help="validate the governance config tables")
    chk.add_argument("--config", help="folder of config CSV files")
    chk.set_defaults(fn=cmd_check_config)

    bld = sub.add_parser("build", help="build, test and publish staging and the mart")
    bld.add_argument("--accounts", required=True, help="account replica (parquet)")
    bld.add_argument("--opportunities", required=True, help="opportunity replica (parquet)")
    bld.add_argument("--target-root", required=True)
    bld.add_argument("--sandbox", help="write <layer>__<model> into this sandbox folder")
    bld.set_defaults(fn=cmd_build)

    mr = sub.add_parser("masked-read", help="read a classified table as a role")
    mr.add_argument("--path", required=True)
    mr.add_argument("--table", required=True, help="SCHEMA.TABLE of the classification")
    mr.add_argument("--role", required=True)
    mr.add_argument("--config", help="folder of config CSV files")
    mr.add_argument("--limit", type=int, help="print or write so many rows only")
    mr.add_argument("--out", help="folder for the whole result (parquet)")
    mr.set_defaults(fn=cmd_masked_read)

    aud = sub.add_parser("audit", help="who read a column, when")
    aud.add_argument("--access-history", required=True)
    aud.add_argument("--query-history", required=True)
    aud.add_argument("--object", required=True, help="ILIKE pattern, e.g. %%SCHEMA.TABLE")
    aud.add_argument("--column", required=True)
    aud.add_argument("--limit", type=int, help="print or write so many rows only")
    aud.add_argument("--out", help="folder for the whole result (parquet)")
    aud.set_defaults(fn=cmd_audit)

    args = ap.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
