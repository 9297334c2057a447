"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them run over whole driver tables (or data Spark derives from them):
``events`` is landed as hourly JSON-array files and ingested, ``orders`` and
``customer`` become CDC feeds, ``orders`` also yields the access history.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import EVENTS, Target
from lakeloom.functions.paths import path_dt, path_hr
from lakeloom.operators import commit as C
from lakeloom.operators import governance as G
from lakeloom.operators import quality as Q
from lakeloom.operators.audit import column_access
from lakeloom.operators.clustered import cluster_raw, events_in_window
from lakeloom.operators.governed_sql import governed_view, register_governance, set_role
from lakeloom.plans import build as B
from lakeloom.plans import marts as M
from lakeloom.plans import monitoring as MON
from lakeloom.plans import staging as STG
from lakeloom.plans.ingest import IngestResult, ingest
from lakeloom.session import scratch_dir, work_root
from lakeloom.sources import standins as S
from lakeloom.sources.cdc import ACCOUNT_CONTRACT, ACCOUNT_TABLE, OPPORTUNITY_CONTRACT, OPPORTUNITY_TABLE, conform
from lakeloom.sources.landing import ScanScope, day_folders
from lakeloom.sources.settings import Governance, read_config

SPEC = EVENTS["product_events"]


@dataclass
class Fixture:
    landing: str
    warehouse: str
    first_load: IngestResult


_FIXTURES: dict[tuple[str, str], Fixture] = {}
_LANDINGS: dict[tuple[str, str], str] = {}


def landing_for(spark: SparkSession, sf_dir: str) -> str:
    """Landing files derived from ``events`` (written once per session)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDINGS:
        root = scratch_dir(spark, "landing")
        S.write_landing(S.table(spark, sf_dir, "events"), root)
        _LANDINGS[key] = root
    return _LANDINGS[key]


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """Landing + one backfill load into a warehouse (once per session)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        landing = landing_for(spark, sf_dir)
        wh = scratch_dir(spark, "warehouse")
        res = ingest(spark, SPEC, landing, wh, ScanScope.backfill())
        _FIXTURES[key] = Fixture(landing, wh, res)
    return _FIXTURES[key]


def _file_cols(c: str = "_filename"):
    return [path_dt(F.col(c)).alias("file_dt"), path_hr(F.col(c)).alias("file_hr")]


def _raw_view(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", "account_id", "event_timestamp",
        F.try_variant_get("payload", "$.user_id", "string").alias("user_id"),
        *_file_cols(), "_pos", F.col("_reason").alias("reason"))


# ------------------------------------------------------------------ ingest

def q_ingest_raw(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return _raw_view(C.committed(spark, fx.warehouse, C.RAW))


def q_ingest_quarantine(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    q = C.committed(spark, fx.warehouse, C.QUARANTINE)
    return q.select("reason", F.try_variant_get("payload", "$.event_id", "string").alias("event_id"),
                    *_file_cols(), "_pos")


def q_ingest_load_log(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    log = C.committed(spark, fx.warehouse, C.LOAD_LOG)
    return log.select(*_file_cols("file_name"), "records_processed", "records_quarantined")


def q_ingest_dry_run(spark, sf_dir):
    """What a backfill into an empty warehouse would load; nothing is written."""
    landing = landing_for(spark, sf_dir)
    res = ingest(spark, SPEC, landing, scratch_dir(spark, "warehouse"), ScanScope.backfill(), dry_run=True)
    return res.report.select(*_file_cols("file_name"), "status")


def q_quarantine_by_reason(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    q = C.committed(spark, fx.warehouse, C.QUARANTINE)
    return q.groupBy("reason").agg(F.count(F.lit(1)).alias("records"),
                                   F.count_distinct("_filename").alias("files"))


def q_ingest_run_totals(spark, sf_dir):
    return fixture(spark, sf_dir).first_load.totals()


def q_ingest_rerun_noop(spark, sf_dir):
    """Second backfill over the same warehouse: every file is skipped."""
    fx = fixture(spark, sf_dir)
    res = ingest(spark, SPEC, fx.landing, fx.warehouse, ScanScope.backfill())
    return res.report.select(*_file_cols("file_name"), "status", "records_processed", "records_quarantined")


def q_ingest_force(spark, sf_dir):
    """Load, then force-load again: every file twice in the log and in RAW."""
    landing = landing_for(spark, sf_dir)
    wh = scratch_dir(spark, "warehouse")
    ingest(spark, SPEC, landing, wh, ScanScope.backfill())
    ingest(spark, SPEC, landing, wh, ScanScope.backfill(), force=True)
    log = C.committed(spark, wh, C.LOAD_LOG).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("loads"),
        F.sum("records_processed").cast("long").alias("records_processed"),
        F.sum("records_quarantined").cast("long").alias("records_quarantined"))
    raw = C.committed(spark, wh, C.RAW).groupBy("_filename").agg(F.count(F.lit(1)).alias("raw_rows"))
    return (log.join(raw, log["file_name"] == raw["_filename"], "left")
            .select(*_file_cols("file_name"), "loads", "records_processed", "records_quarantined", "raw_rows"))


def scan_clock(spark: SparkSession, sf_dir: str) -> datetime:
    """'Now' for the scan-mode query: the hour after the newest event."""
    newest = S.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return newest.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)


def q_scan_modes(spark, sf_dir):
    """Steady-state window run, then a prefill catch-up, then a backfill:
    each file is loaded by exactly one of them (every mode skips loaded files)."""
    landing = landing_for(spark, sf_dir)
    wh = scratch_dir(spark, "warehouse")
    now = scan_clock(spark, sf_dir)
    prefill_from = (now - timedelta(days=7)).date()
    runs = [("window", ScanScope.window(now, 48)), ("prefill", ScanScope.prefill(prefill_from)),
            ("backfill", ScanScope.backfill())]
    reports = []
    for mode, scope in runs:
        r = ingest(spark, SPEC, landing, wh, scope).report
        reports.append(r.where(F.col("status") == "loaded").withColumn("loaded_by", F.lit(mode)))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.select(*_file_cols("file_name"), "loaded_by", "records_processed")


def q_stream_ingest(spark, sf_dir):
    """File-arrival stream (AvailableNow) into a fresh warehouse."""
    from lakeloom.streaming.file_arrival import run_available_now

    landing = landing_for(spark, sf_dir)
    wh = scratch_dir(spark, "warehouse")
    run_available_now(spark, SPEC, landing, wh, scratch_dir(spark, "stream-checkpoint"))
    return _raw_view(C.committed(spark, wh, C.RAW))


def _with_odd_files(spark, sf_dir) -> str:
    """The landed events and a file of every verdict."""
    landing = scratch_dir(spark, "landing")
    S.write_landing(S.table(spark, sf_dir, "events"), landing)
    for name, text in S.ODD_FILES.items():
        S.put_file(spark, f"{landing}/{name}", text)
    return landing


def _verdict_view(rows: DataFrame) -> DataFrame:
    return rows.select(*_file_cols("file_name"), F.regexp_extract("file_name", "chunk=([a-z]+)", 1).alias("kind"), "status", "detail")


def q_ingest_file_verdicts(spark, sf_dir):
    """Every status a file can have in one load."""
    return _verdict_view(ingest(spark, SPEC, _with_odd_files(spark, sf_dir), scratch_dir(spark, "warehouse"), ScanScope.backfill()).report)


def q_stream_file_verdicts(spark, sf_dir):
    """The same files streamed; the broken one is corrected in place, a second run loads it."""
    from lakeloom.streaming.file_arrival import file_verdicts, run_available_now

    landing, wh, checkpoint = _with_odd_files(spark, sf_dir), scratch_dir(spark, "warehouse"), scratch_dir(spark, "stream-checkpoint")
    run_available_now(spark, SPEC, landing, wh, checkpoint)
    S.put_file(spark, f"{landing}/{S.CORRECTED[0]}", S.CORRECTED[1])
    run_available_now(spark, SPEC, landing, wh, checkpoint)
    return _verdict_view(file_verdicts(spark, wh))


def q_ingest_split_arrays(spark, sf_dir):
    """A day's events in a few large arrays, each read by byte ranges."""
    landing, wh = scratch_dir(spark, "landing"), scratch_dir(spark, "warehouse")
    S.write_landing(S.table(spark, sf_dir, "events"), landing, 500_000, hourly=False)
    ingest(spark, SPEC, landing, wh, ScanScope.backfill(), split_arrays=True)
    return _raw_view(C.committed(spark, wh, C.RAW)).drop("file_hr")


def two_arrivals(spark, sf_dir) -> tuple[list[DataFrame], str]:
    """The events' first and second half by time, and a landing root to write them to."""
    ev = S.table(spark, sf_dir, "events")
    span = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    mid = F.lit((span.lo + (span.hi - span.lo) / 2).replace(microsecond=0))
    return [ev.where(F.col("ts") < mid), ev.where(F.col("ts") >= mid)], scratch_dir(spark, "landing")


def q_stream_stg_events(spark, sf_dir):
    """Files that arrive in two halves, streamed to the deduplicated staging table by
    several micro-batches: newest row per event, as in the batch build."""
    from lakeloom.streaming.file_arrival import run_available_now

    halves, landing = two_arrivals(spark, sf_dir)
    wh, snap, checkpoint = (scratch_dir(spark, k) for k in ("warehouse", "snapshot", "stream-checkpoint"))
    for n, half in enumerate(halves):
        S.write_landing(half, f"{landing}/arrival={n}")
        run_available_now(spark, SPEC, landing, wh, checkpoint, staging=snap)
    return _stg_view(STG.current_snapshot(spark, snap))


# ----------------------------------------------------------------- staging

STG_COLUMNS = ["event_id", "user_id", "account_id", "page_name", "session_id",
               "event_timestamp", "prop_k", "prop_value"]


def _stg_view(stg: DataFrame) -> DataFrame:
    return stg.select(*STG_COLUMNS, *_file_cols())


def q_stg_events_latest(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return _stg_view(STG.stg_events(C.committed(spark, fx.warehouse, C.RAW), SPEC))


def q_stg_incremental(spark, sf_dir):
    """Load the first half of the days, build; load the rest, build
    incrementally: equals the full build."""
    landing = landing_for(spark, sf_dir)
    wh = scratch_dir(spark, "warehouse")
    snap = scratch_dir(spark, "snapshot")
    ev = S.table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    mid = ev.lo + (ev.hi - ev.lo) / 2
    first = ScanScope(day_folders(ev.lo.date(), mid.date()), None, "first half")
    keys, order = [SPEC.key_field], list(STG.EVENT_ORDER)
    for scope in (first, ScanScope.backfill()):
        ingest(spark, SPEC, landing, wh, scope)
        typed = STG.typed_events(C.committed(spark, wh, C.RAW), SPEC)
        out = STG.build_incremental(spark, snap, typed, keys, order)
    return _stg_view(out)


def q_events_by_day(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    stg = STG.stg_events(C.committed(spark, fx.warehouse, C.RAW), SPEC)
    day = F.date_trunc("day", "event_timestamp").cast("timestamp_ntz")
    return stg.groupBy(day.alias("event_date"), "page_name").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("user_id").alias("users"),
        F.sum("prop_k").cast("long").alias("sum_k"))


def accounts_feed(spark, sf_dir) -> DataFrame:
    return conform(S.account_feed(S.table(spark, sf_dir, "customer")), ACCOUNT_CONTRACT)


def opportunities_feed(spark, sf_dir) -> DataFrame:
    return conform(S.opportunity_feed(S.table(spark, sf_dir, "orders")), OPPORTUNITY_CONTRACT)


def accounts(spark, sf_dir) -> DataFrame:
    return STG.stg_accounts(accounts_feed(spark, sf_dir))


def opportunities(spark, sf_dir) -> DataFrame:
    return STG.stg_opportunities(opportunities_feed(spark, sf_dir))


def _sliced(feed: DataFrame, key: str) -> DataFrame:
    """The feed as two arrivals by a hash of key and sync time, so that versions, deletes
    and ties of a key lie in both, the newer one now in the first, now in the second."""
    return feed.withColumn("_slice", F.concat(F.lit("slice-"), F.pmod(F.xxhash64(key, "_fivetran_synced"), F.lit(2))))


def q_stg_accounts_incremental(spark, sf_dir):
    feed, root = _sliced(accounts_feed(spark, sf_dir), "account_id"), scratch_dir(spark, "snapshot")
    STG.stg_accounts_incremental(spark, root, feed.where("_slice = 'slice-1'"), "_slice")
    return STG.stg_accounts_incremental(spark, root, feed, "_slice")


def q_stg_opportunities_incremental(spark, sf_dir):
    feed, root = _sliced(opportunities_feed(spark, sf_dir), "opportunity_id"), scratch_dir(spark, "snapshot")
    STG.stg_opportunities_incremental(spark, root, feed.where("_slice = 'slice-1'"), "_slice")
    return STG.stg_opportunities_incremental(spark, root, feed, "_slice")


def q_stg_accounts(spark, sf_dir):
    return accounts(spark, sf_dir)


def q_stg_opportunities(spark, sf_dir):
    return opportunities(spark, sf_dir)


def mart(spark, sf_dir) -> DataFrame:
    return M.mart_opportunities(opportunities(spark, sf_dir), accounts(spark, sf_dir))


def q_mart_opportunities(spark, sf_dir):
    return mart(spark, sf_dir)


def q_pipeline_metrics(spark, sf_dir):
    return M.pipeline_metrics(mart(spark, sf_dir))


def q_mart_finance_bookings(spark, sf_dir):
    return M.finance_bookings(mart(spark, sf_dir))


def q_account_seed_summary(spark, sf_dir):
    return M.seed_summary(accounts(spark, sf_dir), f"DEV_DB.{ACCOUNT_TABLE}")


# ----------------------------------------------------------------- quality

def model_checks() -> list[Q.Check]:
    return [
        Q.not_null("stg_opportunities", "opportunity_id"),
        Q.unique("stg_opportunities", "opportunity_id"),
        Q.accepted_values("stg_opportunities", "stage_name", M.ACCEPTED_STAGES),
        Q.relationships("stg_opportunities", "account_id", "stg_accounts", "account_id", severity="warn"),
        Q.not_null("stg_opportunities", "amount", severity="warn"),
        Q.not_null("stg_opportunities", "close_date", severity="warn"),
        Q.not_null("stg_accounts", "account_id"),
        Q.unique("stg_accounts", "account_id"),
        Q.accepted_values("stg_accounts", "customer_tier", ("Enterprise", "Mid-Market", "SMB")),
        Q.not_null("mart_opportunities", "pipeline_stage_bucket"),
        Q.expression("negative_days_to_close", "mart_opportunities", "days_to_close < 0", severity="warn"),
    ]


def q_dq_checks(spark, sf_dir):
    """All model checks. Each staged model is computed once and checkpointed
    (reliable, in spark.checkpoint.dir); every check and the mart then scan
    that result instead of recomputing the dedup per branch."""
    work_root(spark)  # makes sure a checkpoint folder is set
    opp = opportunities(spark, sf_dir).checkpoint()
    acc = accounts(spark, sf_dir).checkpoint()
    models = {"stg_opportunities": opp, "stg_accounts": acc,
              "mart_opportunities": M.mart_opportunities(opp, acc)}
    return Q.run_checks(models, model_checks())


def gate_checks() -> list[Q.Check]:
    """Checks of which the last one, of error severity, fails on the stand-in feeds."""
    return [
        Q.not_null("stg_accounts", "account_id"),
        Q.accepted_values("stg_accounts", "customer_tier", ("Enterprise", "SMB"), severity="warn"),
        Q.unique("stg_opportunities", "opportunity_id"),
        Q.unique("stg_opportunities", "account_id", severity="warn"),
        Q.pattern("stg_opportunities", "account_id", "^acct_[0-9]+$", severity="warn"),
        Q.conditional_reference("stg_opportunities", "account_id", "stg_accounts", "account_id", "stage_name = 'Closed Won'", severity="warn"),
        Q.one_per_group("mart_opportunities", "owner_id", "stage_name = 'Closed Lost' AND amount > 400000", severity="warn"),
        Q.not_null("mart_opportunities", "amount", severity="warn"),
        Q.expression("negative_days_to_close", "mart_opportunities", "days_to_close < 0"),
    ]


def q_build_gate(spark, sf_dir):
    """A build whose mart fails an error check: every check's row, and whether its model
    was published (staging was, the mart is not)."""
    target = Target(scratch_dir(spark, "models"))
    try:
        summary = B.build_sales_models(spark, accounts_feed(spark, sf_dir), opportunities_feed(spark, sf_dir), target, gate_checks(), governance(spark))
    except Q.QualityError as e:
        summary = e.summary
    layers = {"stg_accounts": "staging", "stg_opportunities": "staging", "mart_opportunities": "marts"}
    published = [m for m, layer in layers.items() if B.read_model(spark, target.path(layer, m)) is not None]
    return summary.withColumn("published", F.col("model").isin(published))


def q_load_monitoring(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    log = C.committed(spark, fx.warehouse, C.LOAD_LOG).withColumn("file_dt", path_dt(F.col("file_name")))
    return MON.reject_rate(log, by=("file_dt",), threshold=0.05)


def q_freshness(spark, sf_dir):
    """Event-time freshness per page against a 2 h SLA, 'now' = scan clock."""
    fx = fixture(spark, sf_dir)
    stg = STG.stg_events(C.committed(spark, fx.warehouse, C.RAW), SPEC)
    return MON.freshness(stg, "event_timestamp", scan_clock(spark, sf_dir), 2.0, by=("page_name",))


def q_drift_report(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return MON.drift_report(C.committed(spark, fx.warehouse, C.RAW), SPEC)


def q_events_in_window(spark, sf_dir):
    """RAW rows of the day that ends at the scan clock, from the files of clustered RAW that meet it."""
    fx = fixture(spark, sf_dir)
    cluster_raw(spark, fx.warehouse, rows_per_file=20_000)
    now = scan_clock(spark, sf_dir)
    return _raw_view(events_in_window(spark, fx.warehouse, now - timedelta(days=1), now))


# Types of the telemetry payload's paths.
PAYLOAD_TYPES = {"event_id": "STRING", "account_id": "STRING", "user_id": "STRING", "event_timestamp": "STRING",
                 "page_name": "STRING", "session_id": "STRING", "properties": "OBJECT", "properties.k": "BIGINT",
                 "properties.value": "DOUBLE", "properties.referrer": "STRING"}


def q_drift_nested(spark, sf_dir):
    """Nested payload drift over records with a new, a retyped and a widened key."""
    raw = S.drifted_records(S.table(spark, sf_dir, "events")).select(F.parse_json("json").alias("payload"))
    return MON.nested_drift(raw, PAYLOAD_TYPES)


# -------------------------------------------------------------- governance

_GOV: dict[str, Governance] = {}


def governance(spark) -> Governance:
    """The deployment's governance config, loaded once per session."""
    key = spark.sparkContext.applicationId
    if key not in _GOV:
        _GOV[key] = Governance.load(spark)
    return _GOV[key]


def _accounts_for_masking(spark, sf_dir):
    return accounts(spark, sf_dir).select("account_id", "account_name", "arr")


def q_masked_reader(spark, sf_dir):
    gov = governance(spark)
    return G.masked(spark, _accounts_for_masking(spark, sf_dir), ACCOUNT_TABLE, "REVOPS_READER", gov)


def q_masked_exempt(spark, sf_dir):
    """SYSADMIN is exempt through granted_to (it holds REVOPS_ADMIN)."""
    gov = governance(spark)
    return G.masked(spark, _accounts_for_masking(spark, sf_dir), ACCOUNT_TABLE, "SYSADMIN", gov)


def q_masked_sql_view(spark, sf_dir):
    """One governed view read in plain SQL under two roles of one session."""
    gov = governance(spark)
    register_governance(spark, gov)
    governed_view(spark, gov, "governed_accounts", _accounts_for_masking(spark, sf_dir), ACCOUNT_TABLE)
    parts = []
    for role in ("REVOPS_READER", "SYSADMIN"):
        set_role(spark, role)
        parts.append(spark.sql("SELECT active_role AS as_role, * FROM governed_accounts"))
    return parts[0].unionByName(parts[1])


def q_masked_mart(spark, sf_dir):
    """The built mart read by REVOPS_READER: its own tags mask the derived columns."""
    df = _built(spark, sf_dir, "marts", "mart_opportunities").select(
        "opportunity_id", "stage_name", "pipeline_stage_bucket", "amount", "weighted_amount")
    return G.masked(spark, df, None, "REVOPS_READER", governance(spark))


def q_masked_staging(spark, sf_dir):
    """The built account staging read by REVOPS_READER, no tags passed."""
    df = _built(spark, sf_dir, "staging", "stg_accounts").select("account_id", "account_name", "arr")
    return G.masked(spark, df, None, "REVOPS_READER", governance(spark))


_BUILDS: dict[tuple[str, str], Target] = {}


def _built(spark, sf_dir, layer: str, model: str) -> DataFrame:
    """A published model of a build over the CDC feeds (built once per session)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILDS:
        target = Target(scratch_dir(spark, "models"))
        B.build_sales_models(spark, accounts_feed(spark, sf_dir), opportunities_feed(spark, sf_dir), target, [], governance(spark))
        _BUILDS[key] = target
    return B.read_model(spark, _BUILDS[key].path(layer, model))


def _contacts(spark, sf_dir) -> DataFrame:
    c = S.table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("acct_"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.format_string("555-%03d-%04d", F.col("c_nationkey"), F.col("c_custkey") % 10000).alias("phone"))


def _contact_gov(spark) -> Governance:
    """The same config with the contact and phone rules switched on."""
    key = spark.sparkContext.applicationId + "/contact"
    if key not in _GOV:
        rules = read_config(spark, "masking_rules").withColumn("is_active", F.lit(True))
        _GOV[key] = Governance.load(spark, masking_rules=rules)
    return _GOV[key]


CONTACT_TAGS = {"email": ("PII_CONTACT", "email"), "phone": ("PII_PHONE", "phone")}


def q_mask_email(spark, sf_dir):
    gov = _contact_gov(spark)
    df = _contacts(spark, sf_dir).select("account_id", "email")
    return G.masked(spark, df, None, "REVOPS_READER", gov, column_tags=CONTACT_TAGS)


def q_mask_phone(spark, sf_dir):
    gov = _contact_gov(spark)
    df = _contacts(spark, sf_dir).select("account_id", "phone")
    return G.masked(spark, df, None, "REVOPS_READER", gov, column_tags=CONTACT_TAGS)


def q_row_access(spark, sf_dir):
    """Customers REVOPS_ADMIN may see: its own regions plus the ones of the
    roles it inherits."""
    gov = Governance.load(spark)
    cust = S.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = S.table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    geo = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "region")
    visible = G.row_filter(spark, geo, F.col("region"), "REVOPS_ADMIN", gov)
    return cust.join(visible, cust["c_nationkey"] == visible["n_nationkey"]).select("c_custkey", "c_name", "region")


def q_access_audit(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders")
    return column_access(S.access_history(orders), S.query_history(orders),
                         "%SALESFORCE_RAW_FIVETRAN.ACCOUNT", "ARR")


# Nullable integer columns handed over as doubles (both engines then give the
# same pandas type for a column that holds NULLs).
NULLABLE_INTS = {"days_to_close"}


def report_view(df: DataFrame) -> DataFrame:
    """Hand-over form of a result for cross-engine comparison: exact decimals
    become the (correctly rounded) double of the same value and calendar dates
    become midnight timestamps. Models themselves keep decimal and date types."""
    from pyspark.sql.types import DateType, DecimalType

    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType) or f.name in NULLABLE_INTS:
            c = c.cast("double")
        elif isinstance(f.dataType, DateType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _reported(fn):
    def run(spark, sf_dir):
        return report_view(fn(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES = {
    "ingest_raw": q_ingest_raw,
    "ingest_quarantine": q_ingest_quarantine,
    "ingest_load_log": q_ingest_load_log,
    "ingest_run_totals": q_ingest_run_totals,
    "ingest_dry_run": q_ingest_dry_run,
    "quarantine_by_reason": q_quarantine_by_reason,
    "ingest_rerun_noop": q_ingest_rerun_noop,
    "ingest_force": q_ingest_force,
    "scan_modes": q_scan_modes,
    "stream_ingest": q_stream_ingest,
    "stream_stg_events": q_stream_stg_events,
    "ingest_file_verdicts": q_ingest_file_verdicts,
    "stream_file_verdicts": q_stream_file_verdicts,
    "ingest_split_arrays": q_ingest_split_arrays,
    "stg_events_latest": q_stg_events_latest,
    "stg_incremental_equals_full": q_stg_incremental,
    "events_by_day": q_events_by_day,
    "stg_accounts": q_stg_accounts,
    "stg_opportunities": q_stg_opportunities,
    "mart_opportunities": q_mart_opportunities,
    "pipeline_metrics": q_pipeline_metrics,
    "mart_finance_bookings": q_mart_finance_bookings,
    "account_seed_summary": q_account_seed_summary,
    "dq_checks": q_dq_checks,
    "build_gate": q_build_gate,
    "load_monitoring": q_load_monitoring,
    "freshness": q_freshness,
    "drift_report": q_drift_report,
    "drift_nested": q_drift_nested,
    "events_in_window": q_events_in_window,
    "masked_reader": q_masked_reader,
    "masked_exempt": q_masked_exempt,
    "masked_mart": q_masked_mart,
    "masked_sql_view": q_masked_sql_view,
    "masked_staging": q_masked_staging,
    "stg_accounts_incremental": q_stg_accounts_incremental,
    "stg_opportunities_incremental": q_stg_opportunities_incremental,
    "mask_email": q_mask_email,
    "mask_phone": q_mask_phone,
    "row_access": q_row_access,
    "access_audit": q_access_audit,
}
QUERIES = {name: _reported(fn) for name, fn in QUERIES.items()}
