"""DuckDB SQL oracles, one per registered query (same names, same columns).

They recompute each result from the driver tables directly: the landed
records from the injection rules, the CDC versions from their rules, and the
expected effect of each operator in plain SQL.
"""

from __future__ import annotations

# Landed telemetry records, exactly as the landing writer lays them out.
_LANDED = """
rec AS (
  SELECT event_id AS n, ts, user_id AS u, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 0 AS copy, ts AS file_ts
  FROM events
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) + 1000, 1, ts + INTERVAL 1 HOUR
  FROM events WHERE event_id % 50 = 0
),
hours AS (
  SELECT *, COUNT(*) OVER (PARTITION BY strftime(file_ts, '%Y-%m-%d %H')) AS hour_count FROM rec
),
chunked AS (
  SELECT *, n % CAST(ceil(hour_count / 5000.0) AS BIGINT) AS chunk FROM hours
),
landed AS (
  SELECT n, ts, u, copy, chunk,
         strftime(file_ts, '%Y-%m-%d') AS file_dt,
         strftime(file_ts, '%H') AS file_hr,
         CAST(row_number() OVER (PARTITION BY strftime(file_ts, '%Y-%m-%d %H'), chunk
                                 ORDER BY ts, n, copy) - 1 AS INTEGER) AS _pos,
         'evt_' || CAST(n AS VARCHAR) AS event_id,
         CASE WHEN n % 97 = 0 THEN NULL ELSE 'usr_' || CAST(u AS VARCHAR) END AS user_id,
         CASE WHEN n % 89 = 0 THEN '' ELSE 'acct_' || CAST(u AS VARCHAR) END AS account_id,
         CASE WHEN n % 83 = 0 THEN NULL ELSE ts END AS event_timestamp,
         event_type AS page_name,
         'sess_' || CAST(u AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS session_id,
         k AS prop_k,
         value AS prop_value,
         NULLIF(concat_ws(', ',
             CASE WHEN n % 89 = 0 THEN 'account_id' END,
             CASE WHEN n % 83 = 0 THEN 'event_timestamp' END,
             CASE WHEN n % 97 = 0 THEN 'user_id' END), '') AS missing
  FROM chunked
),
raw AS (
  SELECT *, CASE WHEN missing IS NOT NULL
                 THEN 'missing/null required field(s): ' || missing END AS reason
  FROM landed
),
stg AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id
                                 ORDER BY file_dt DESC, file_hr DESC, chunk DESC, _pos DESC) AS rn
    FROM raw WHERE reason IS NULL) WHERE rn = 1
)
"""

_RAW_COLS = "event_id, account_id, event_timestamp, user_id, file_dt, file_hr, _pos, reason"
_STG_COLS = ("event_id, user_id, account_id, page_name, session_id, event_timestamp, "
             "prop_k, prop_value, file_dt, file_hr")

_STAGES = """
CASE o_orderpriority WHEN '1-URGENT' THEN 'Closed Won' WHEN '2-HIGH' THEN 'Negotiation'
     WHEN '3-MEDIUM' THEN 'Qualification' WHEN '4-NOT SPECIFIED' THEN 'Prospecting'
     WHEN '5-LOW' THEN 'Closed Lost' END
"""

# Newest version per opportunity is always the current one by construction
# (older versions sync earlier; the tie version has an older modification).
_CDC = f"""
opp AS (
  SELECT 'opp_' || CAST(o_orderkey AS VARCHAR) AS opportunity_id,
         CASE WHEN o_orderkey % 997 = 0 THEN 'acct_missing_' || CAST(o_orderkey AS VARCHAR)
              ELSE 'acct_' || CAST(o_custkey AS VARCHAR) END AS account_id,
         'own_' || CAST(o_orderkey % 7 AS VARCHAR) AS owner_id,
         {_STAGES} AS stage_name,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
         CASE WHEN o_orderkey % 103 = 0 THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 - 20 AS INTEGER) END AS close_date,
         o_orderdate AS created_date,
         o_orderdate + INTERVAL 20 DAY AS last_modified_date,
         o_orderdate + INTERVAL 30 DAY AS _fivetran_synced
  FROM orders
  WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 11 = 0)
),
acc AS (
  SELECT 'acct_' || CAST(c_custkey AS VARCHAR) AS account_id,
         c_name AS account_name,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS industry,
         CAST(c_acctbal AS DECIMAL(18,2)) AS arr,
         'N' || CAST(c_nationkey AS VARCHAR) AS billing_state,
         CASE WHEN c_acctbal >= 5000 THEN 'Enterprise' WHEN c_acctbal >= 1000 THEN 'Mid-Market'
              ELSE 'SMB' END AS customer_tier,
         TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL 1 MINUTE AS created_date,
         TIMESTAMP '2026-01-01 00:00:00' AS _fivetran_synced
  FROM customer
),
mart AS (
  SELECT o.opportunity_id, o.account_id, a.account_name, a.industry, a.customer_tier,
         a.billing_state, o.owner_id, o.stage_name, o.amount, o.close_date, o.created_date,
         CAST(o.close_date - CAST(o.created_date AS DATE) AS INTEGER) AS days_to_close,
         CASE o.stage_name WHEN 'Prospecting' THEN 'early' WHEN 'Qualification' THEN 'early'
              WHEN 'Negotiation' THEN 'late' WHEN 'Closed Won' THEN 'won'
              WHEN 'Closed Lost' THEN 'lost' ELSE 'unknown' END AS pipeline_stage_bucket,
         CAST(o.amount * CASE o.stage_name WHEN 'Prospecting' THEN 0.10 WHEN 'Qualification' THEN 0.25
              WHEN 'Negotiation' THEN 0.60 WHEN 'Closed Won' THEN 1.00 WHEN 'Closed Lost' THEN 0.00 END
              AS DECIMAL(18,2)) AS weighted_amount
  FROM opp o LEFT JOIN acc a ON o.account_id = a.account_id
)
"""

_AUDIT = """
WITH ah AS (
  SELECT 'q' || CAST(o_orderkey AS VARCHAR) AS query_id,
         o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS query_start_time,
         'USER_' || CAST(o_custkey % 20 AS VARCHAR) AS user_name,
         CASE o_orderpriority
           WHEN '1-URGENT' THEN [
             {'objectName': 'PROD_DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT',
              'columns': [{'columnName': 'ACCOUNT_NAME'}, {'columnName': 'ARR'}]},
             {'objectName': 'PROD_DB.SALESFORCE_RAW_FIVETRAN.OPPORTUNITY',
              'columns': [{'columnName': 'AMOUNT'}]}]
           WHEN '2-HIGH' THEN [
             {'objectName': 'PROD_DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT',
              'columns': [{'columnName': 'ARR'}]}]
           WHEN '3-MEDIUM' THEN [
             {'objectName': 'PROD_DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT',
              'columns': [{'columnName': 'ACCOUNT_NAME'}, {'columnName': 'INDUSTRY'}]}]
           WHEN '4-NOT SPECIFIED' THEN [
             {'objectName': 'PROD_DB.MARTS_REVOPS.MART_REVOPS__PIPELINE',
              'columns': [{'columnName': 'ARR'}, {'columnName': 'AMOUNT'}]}]
           ELSE [
             {'objectName': 'PROD_DB.SALESFORCE_RAW_FIVETRAN.OPPORTUNITY',
              'columns': [{'columnName': 'AMOUNT'}, {'columnName': 'STAGE_NAME'}]},
             {'objectName': 'PROD_DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT',
              'columns': [{'columnName': 'ARR'}, {'columnName': 'BILLING_STATE'}]}]
         END AS base_objects_accessed
  FROM orders
),
qh AS (
  SELECT 'q' || CAST(o_orderkey AS VARCHAR) AS query_id,
         CASE o_orderstatus WHEN 'F' THEN 'REVOPS_ADMIN' WHEN 'O' THEN 'REVOPS_ANALYST'
              WHEN 'P' THEN 'REVOPS_READER' END AS role_name
  FROM orders
),
objs AS (
  SELECT query_id, query_start_time, user_name, unnest(base_objects_accessed) AS f FROM ah
),
cols AS (
  SELECT query_id, query_start_time, user_name, f.objectName AS table_fqn,
         unnest(f.columns) AS c
  FROM objs WHERE f.objectName ILIKE '%SALESFORCE_RAW_FIVETRAN.ACCOUNT'
)
SELECT cols.query_start_time, cols.user_name, qh.role_name, cols.table_fqn
FROM cols JOIN qh USING (query_id)
WHERE c.columnName = 'ARR'
ORDER BY cols.query_start_time DESC
"""


def _dbl(sql: str, *cols: str) -> str:
    """Decimals handed over as doubles (see catalog.report_view)."""
    repl = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


def _verdicts(broken: str) -> str:
    odd = ", ".join(f"({dt}, {hr}, '{kind}', '{status}', {detail})" for dt, hr, kind, status, detail in [
        ("'1999-01-01'", "'01'", "broken", *broken), ("'1999-01-01'", "'02'", "object", "failed", "'file is not a JSON array'"),
        ("'1999-01-01'", "'03'", "empty", "empty", "'empty array (no rows; rescanned next run)'"),
        ("'1999-01-01'", "'04'", "nothing", "failed", "'file is not a JSON array'"), ("NULL", "NULL", "late", "loaded", "NULL")])
    return _w(f"""SELECT file_dt, file_hr, '' AS kind, 'loaded' AS status, CAST(NULL AS VARCHAR) AS detail
                  FROM (SELECT DISTINCT file_dt, file_hr, chunk FROM raw) UNION ALL SELECT * FROM (VALUES {odd})""")


def _w(body: str) -> str:
    return "WITH " + _LANDED + body


def _c(body: str) -> str:
    return "WITH " + _CDC + body


ORACLES: dict[str, str] = {
    "ingest_raw": _w(f"SELECT {_RAW_COLS} FROM raw"),
    "stream_ingest": _w(f"SELECT {_RAW_COLS} FROM raw"),
    "ingest_quarantine": _w("SELECT reason, event_id, file_dt, file_hr, _pos FROM raw WHERE reason IS NOT NULL"),
    "ingest_load_log": _w("""
        SELECT file_dt, file_hr, COUNT(*) AS records_processed, COUNT(reason) AS records_quarantined
        FROM raw GROUP BY file_dt, file_hr, chunk"""),
    "ingest_run_totals": _w("""
        SELECT COUNT(DISTINCT file_dt || '/' || file_hr || '/' || CAST(chunk AS VARCHAR)) AS files_loaded, COUNT(*) AS rows_loaded,
               COUNT(reason) AS rows_quarantined FROM raw"""),
    "ingest_dry_run": _w("""
        SELECT file_dt, file_hr, 'would load' AS status
        FROM (SELECT DISTINCT file_dt, file_hr, chunk FROM raw)"""),
    "quarantine_by_reason": _w("""
        SELECT reason, COUNT(*) AS records,
               COUNT(DISTINCT file_dt || '/' || file_hr || '/' || CAST(chunk AS VARCHAR)) AS files
        FROM raw WHERE reason IS NOT NULL GROUP BY reason"""),
    "ingest_rerun_noop": _w("""
        SELECT file_dt, file_hr, 'skipped' AS status, CAST(0 AS BIGINT) AS records_processed,
               CAST(0 AS BIGINT) AS records_quarantined
        FROM (SELECT DISTINCT file_dt, file_hr, chunk FROM raw)"""),
    "ingest_force": _w("""
        SELECT file_dt, file_hr, CAST(2 AS BIGINT) AS loads, 2 * COUNT(*) AS records_processed,
               2 * COUNT(reason) AS records_quarantined, 2 * COUNT(*) AS raw_rows
        FROM raw GROUP BY file_dt, file_hr, chunk"""),
    "scan_modes": _w("""
        , clock AS (SELECT date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS now FROM events),
        files AS (
          SELECT file_dt, file_hr, COUNT(*) AS records_processed,
                 strptime(file_dt || ' ' || file_hr, '%Y-%m-%d %H') AS ft
          FROM raw GROUP BY file_dt, file_hr, chunk)
        SELECT file_dt, file_hr,
               CASE WHEN ft >= now - INTERVAL 48 HOUR THEN 'window'
                    WHEN ft >= CAST(CAST(now - INTERVAL 7 DAY AS DATE) AS TIMESTAMP) THEN 'prefill'
                    ELSE 'backfill' END AS loaded_by,
               records_processed
        FROM files CROSS JOIN clock"""),
    "stg_events_latest": _w(f"SELECT {_STG_COLS} FROM stg"),
    "ingest_file_verdicts": _verdicts(("failed", "'file is not a JSON array'")),
    "stream_file_verdicts": _verdicts(("loaded", "NULL")),
    "ingest_split_arrays": _w("""
        , days AS (SELECT *, COUNT(*) OVER (PARTITION BY file_dt) AS day_count FROM raw),
        places AS (SELECT *, n % CAST(ceil(day_count / 500000.0) AS BIGINT) AS day_chunk FROM days)
        SELECT event_id, account_id, event_timestamp, user_id, file_dt, reason,
               CAST(row_number() OVER (PARTITION BY file_dt, day_chunk ORDER BY ts, n, copy) - 1 AS INTEGER) AS _pos FROM places"""),
    "stream_stg_events": _w(f"SELECT {_STG_COLS} FROM stg"),
    "stg_incremental_equals_full": _w(f"SELECT {_STG_COLS} FROM stg"),
    "events_by_day": _w("""
        SELECT date_trunc('day', event_timestamp) AS event_date, page_name, COUNT(*) AS events,
               COUNT(DISTINCT user_id) AS users, CAST(SUM(prop_k) AS BIGINT) AS sum_k
        FROM stg GROUP BY 1, 2"""),
    "stg_accounts": _dbl(_c("SELECT * FROM acc"), "arr"),
    "stg_opportunities": _dbl(_c("""
        SELECT opportunity_id, account_id, owner_id, stage_name, amount,
               CAST(close_date AS TIMESTAMP) AS close_date, created_date,
               last_modified_date, _fivetran_synced FROM opp"""), "amount"),
    "mart_opportunities": _dbl(_c("SELECT * REPLACE (CAST(close_date AS TIMESTAMP) AS close_date) FROM mart"),
                               "amount", "weighted_amount", "days_to_close"),
    "pipeline_metrics": _dbl(_c("""
        SELECT pipeline_stage_bucket, customer_tier, COUNT(*) AS opportunities,
               CAST(SUM(amount) AS DECIMAL(38,2)) AS total_amount,
               CAST(SUM(weighted_amount) AS DECIMAL(38,2)) AS weighted_pipeline,
               CAST(AVG(days_to_close) AS DECIMAL(18,2)) AS avg_days_to_close
        FROM mart GROUP BY 1, 2"""), "total_amount", "weighted_pipeline", "avg_days_to_close"),
    "mart_finance_bookings": _dbl(_c("""
        SELECT strftime(close_date, '%Y-%m') AS close_month, industry, COUNT(*) AS bookings,
               CAST(SUM(amount) AS DECIMAL(38,2)) AS booked_amount,
               COUNT(DISTINCT account_id) AS accounts
        FROM mart WHERE stage_name = 'Closed Won' AND close_date IS NOT NULL
        GROUP BY 1, 2"""), "booked_amount"),
    "freshness": _dbl(_w("""
        , clock AS (SELECT date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS now FROM events),
        per_page AS (SELECT page_name, max(event_timestamp) AS latest FROM stg GROUP BY page_name)
        SELECT page_name, latest,
               CAST(CAST(epoch_us(now) - epoch_us(latest) AS DECIMAL(20,0)) / 3600000000 AS DECIMAL(18,3))
                 AS lag_hours,
               CASE WHEN CAST(CAST(epoch_us(now) - epoch_us(latest) AS DECIMAL(20,0)) / 3600000000
                              AS DECIMAL(18,3)) <= 2 THEN 'fresh' ELSE 'stale' END AS status
        FROM per_page CROSS JOIN clock"""), "lag_hours"),
    "masked_mart": _dbl(_c("""
        SELECT opportunity_id, stage_name, pipeline_stage_bucket, CAST(NULL AS DECIMAL(18,2)) AS amount,
               CAST(NULL AS DECIMAL(18,2)) AS weighted_amount FROM mart"""), "amount", "weighted_amount"),
    "account_seed_summary": """
        SELECT 'seeded ' || CAST(COUNT(*) AS VARCHAR)
               || ' accounts into DEV_DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT' AS result
        FROM customer""",
    "dq_checks": _c("""
        , counts AS (
          SELECT 'not_null_stg_opportunities_opportunity_id' AS check_name, 'stg_opportunities' AS model,
                 'not_null' AS check_type, CAST(0 AS BIGINT) AS failures, 'error' AS severity
          UNION ALL SELECT 'unique_stg_opportunities_opportunity_id', 'stg_opportunities', 'unique', 0, 'error'
          UNION ALL SELECT 'accepted_values_stg_opportunities_stage_name', 'stg_opportunities',
                 'accepted_values', 0, 'error'
          UNION ALL SELECT 'relationships_stg_opportunities_account_id__stg_accounts_account_id',
                 'stg_opportunities', 'relationships',
                 (SELECT COUNT(*) FROM opp WHERE account_id NOT IN (SELECT account_id FROM acc)), 'warn'
          UNION ALL SELECT 'not_null_stg_opportunities_amount', 'stg_opportunities', 'not_null',
                 (SELECT COUNT(*) FROM opp WHERE amount IS NULL), 'warn'
          UNION ALL SELECT 'not_null_stg_opportunities_close_date', 'stg_opportunities', 'not_null',
                 (SELECT COUNT(*) FROM opp WHERE close_date IS NULL), 'warn'
          UNION ALL SELECT 'not_null_stg_accounts_account_id', 'stg_accounts', 'not_null', 0, 'error'
          UNION ALL SELECT 'unique_stg_accounts_account_id', 'stg_accounts', 'unique', 0, 'error'
          UNION ALL SELECT 'accepted_values_stg_accounts_customer_tier', 'stg_accounts',
                 'accepted_values', 0, 'error'
          UNION ALL SELECT 'not_null_mart_opportunities_pipeline_stage_bucket', 'mart_opportunities',
                 'not_null', 0, 'error'
          UNION ALL SELECT 'negative_days_to_close', 'mart_opportunities', 'expression',
                 (SELECT COUNT(*) FROM mart WHERE days_to_close < 0), 'warn')
        SELECT check_name, model, check_type, failures, severity,
               CASE WHEN failures <= 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status
        FROM counts"""),
    "build_gate": _c("""
        , owners AS (SELECT owner_id, COUNT(*) FILTER (WHERE stage_name = 'Closed Lost' AND amount > 400000) AS hits FROM mart GROUP BY owner_id),
        counts AS (
          SELECT 'not_null_stg_accounts_account_id' AS check_name, 'stg_accounts' AS model, 'not_null' AS check_type,
                 (SELECT COUNT(*) FROM acc WHERE account_id IS NULL) AS failures, 'error' AS severity
          UNION ALL SELECT 'accepted_values_stg_accounts_customer_tier', 'stg_accounts', 'accepted_values',
                 (SELECT COUNT(*) FROM acc WHERE customer_tier NOT IN ('Enterprise', 'SMB')), 'warn'
          UNION ALL SELECT 'unique_stg_opportunities_opportunity_id', 'stg_opportunities', 'unique',
                 (SELECT COUNT(*) FROM (SELECT opportunity_id FROM opp GROUP BY 1 HAVING COUNT(*) > 1)), 'error'
          UNION ALL SELECT 'unique_stg_opportunities_account_id', 'stg_opportunities', 'unique',
                 (SELECT COUNT(*) FROM (SELECT account_id FROM opp GROUP BY 1 HAVING COUNT(*) > 1)), 'warn'
          UNION ALL SELECT 'pattern_stg_opportunities_account_id', 'stg_opportunities', 'pattern',
                 (SELECT COUNT(*) FROM opp WHERE NOT regexp_matches(account_id, '^acct_[0-9]+$')), 'warn'
          UNION ALL SELECT 'conditional_reference_stg_opportunities_account_id', 'stg_opportunities', 'conditional_reference',
                 (SELECT COUNT(*) FROM opp WHERE stage_name = 'Closed Won' AND account_id NOT IN (SELECT account_id FROM acc)), 'warn'
          UNION ALL SELECT 'one_per_group_mart_opportunities_owner_id', 'mart_opportunities', 'one_per_group',
                 (SELECT COUNT(*) FROM owners WHERE hits <> 1), 'warn'
          UNION ALL SELECT 'not_null_mart_opportunities_amount', 'mart_opportunities', 'not_null',
                 (SELECT COUNT(*) FROM mart WHERE amount IS NULL), 'warn'
          UNION ALL SELECT 'negative_days_to_close', 'mart_opportunities', 'expression',
                 (SELECT COUNT(*) FROM mart WHERE days_to_close < 0), 'error')
        SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status,
               model <> 'mart_opportunities' AS published FROM counts"""),
    "load_monitoring": _dbl(_w("""
        , per_day AS (
          SELECT file_dt, COUNT(DISTINCT file_hr || '/' || CAST(chunk AS VARCHAR)) AS files,
                 COUNT(*) AS records_processed,
                 COUNT(reason) AS records_quarantined FROM raw GROUP BY file_dt)
        SELECT file_dt, files, records_processed, records_quarantined,
               CAST(CAST(records_quarantined AS DECIMAL(20,0)) / records_processed AS DECIMAL(12,6)) AS reject_rate,
               CAST(CAST(records_quarantined AS DECIMAL(20,0)) / records_processed AS DECIMAL(12,6)) > 0.05 AS alert
        FROM per_day"""), "reject_rate"),
    "drift_report": _w("""
        , t AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE n % 83 = 0) AS no_ts FROM raw)
        SELECT 'event_id' AS key, total AS records_with_key, 'contract' AS status, CAST(0 AS BIGINT) AS records_without FROM t
        UNION ALL SELECT 'account_id', total, 'contract', 0 FROM t
        UNION ALL SELECT 'user_id', total, 'contract', 0 FROM t
        UNION ALL SELECT 'event_timestamp', total - no_ts, 'contract', no_ts FROM t
        UNION ALL SELECT 'page_name', total, 'known', 0 FROM t
        UNION ALL SELECT 'session_id', total, 'known', 0 FROM t
        UNION ALL SELECT 'properties', total, 'known', 0 FROM t"""),
    "events_in_window": _w(f"""
        , clock AS (SELECT date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS now FROM events)
        SELECT {_RAW_COLS} FROM raw, clock
        WHERE event_timestamp >= now - INTERVAL 1 DAY AND event_timestamp < now"""),
    "drift_nested": _w("""
        , t AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE n % 83 = 0) AS no_ts,
                       COUNT(*) FILTER (WHERE n % 97 = 0) AS no_user,
                       COUNT(*) FILTER (WHERE n % 41 = 0) AS camp, COUNT(*) FILTER (WHERE n % 43 = 0) AS sess,
                       COUNT(*) FILTER (WHERE n % 47 = 0) AS wide,
                       COUNT(*) FILTER (WHERE prop_value IS NULL) AS no_value,
                       COUNT(*) FILTER (WHERE prop_value <> 0 AND (abs(prop_value) < 0.001 OR abs(prop_value) >= 1e7)) AS e FROM raw),
        seen AS (
          SELECT 'event_id' AS path, 'STRING' AS types, 'STRING' AS merged_type, total AS records_with, 0 AS records_null, 'same' AS status FROM t
          UNION ALL SELECT 'account_id', 'STRING', 'STRING', total, 0, 'same' FROM t
          UNION ALL SELECT 'user_id', 'STRING', 'STRING', total, no_user, 'same' FROM t
          UNION ALL SELECT 'event_timestamp', 'STRING', 'STRING', total - no_ts, 0, 'same' FROM t
          UNION ALL SELECT 'page_name', 'STRING', 'STRING', total, 0, 'same' FROM t
          UNION ALL SELECT 'session_id', CASE WHEN sess > 0 THEN 'BIGINT,STRING' ELSE 'STRING' END,
                           CASE WHEN sess > 0 THEN 'VARIANT' ELSE 'STRING' END, total, 0,
                           CASE WHEN sess > 0 THEN 'breaking' ELSE 'same' END FROM t
          UNION ALL SELECT 'properties', 'OBJECT', 'OBJECT', total, 0, 'same' FROM t
          UNION ALL SELECT 'properties.k', CASE WHEN wide > 0 THEN 'BIGINT,DECIMAL' ELSE 'BIGINT' END,
                           CASE WHEN wide > 0 THEN 'DECIMAL' ELSE 'BIGINT' END, total, 0,
                           CASE WHEN wide > 0 THEN 'widened' ELSE 'same' END FROM t
          UNION ALL SELECT 'properties.value', CASE WHEN e > 0 THEN 'DECIMAL,DOUBLE' ELSE 'DECIMAL' END,
                           CASE WHEN e > 0 THEN 'DOUBLE' ELSE 'DECIMAL' END, total, no_value, 'same' FROM t
          UNION ALL SELECT 'properties.campaign', 'OBJECT', 'OBJECT', camp, 0, 'additive' FROM t WHERE camp > 0
          UNION ALL SELECT 'properties.campaign.id', 'BIGINT', 'BIGINT', camp, 0, 'additive' FROM t WHERE camp > 0
          UNION ALL SELECT 'properties.campaign.tags', 'ARRAY', 'ARRAY', camp, 0, 'additive' FROM t WHERE camp > 0
          UNION ALL SELECT 'properties.campaign.tags[]', 'STRING', 'STRING', camp, 0, 'additive' FROM t WHERE camp > 0
          UNION ALL SELECT 'properties.referrer', '', NULL, 0, 0, 'missing')
        SELECT path, types, merged_type, CAST(records_with AS BIGINT) AS records_with, CAST(records_null AS BIGINT) AS records_null,
               CAST(total - records_with AS BIGINT) AS records_without, status FROM seen, t"""),
    "masked_reader": _dbl(_c("SELECT account_id, account_name, CAST(NULL AS DECIMAL(18,2)) AS arr FROM acc"), "arr"),
    "masked_staging": _dbl(_c("SELECT account_id, account_name, CAST(NULL AS DECIMAL(18,2)) AS arr FROM acc"), "arr"),
    "masked_sql_view": _dbl(_c("""
        SELECT 'REVOPS_READER' AS as_role, account_id, account_name, CAST(NULL AS DECIMAL(18,2)) AS arr FROM acc
        UNION ALL SELECT 'SYSADMIN', account_id, account_name, arr FROM acc"""), "arr"),
    "masked_exempt": _dbl(_c("SELECT account_id, account_name, arr FROM acc"), "arr"),
    "mask_email": """
        SELECT 'acct_' || CAST(c_custkey AS VARCHAR) AS account_id,
               regexp_replace(lower(replace(c_name, '#', '.')) || '@example.com', '^[^@]+', '****') AS email
        FROM customer""",
    "mask_phone": """
        SELECT 'acct_' || CAST(c_custkey AS VARCHAR) AS account_id,
               '***-***-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone
        FROM customer""",
    "row_access": """
        SELECT c_custkey, c_name, r_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name IN ('AFRICA', 'MIDDLE EAST', 'AMERICA', 'EUROPE')""",
    "access_audit": _AUDIT,
}

# Built from slices, the result is that of the full staging.
for _model in ("stg_accounts", "stg_opportunities"):
    ORACLES[f"{_model}_incremental"] = ORACLES[_model]
