"""Staging models: typed, deduplicated, soft-deletes dropped.

* ``stg_events``        RAW telemetry -> contract-valid rows -> typed payload
                        paths -> newest row per event id.
* ``stg_accounts``      CDC accounts  -> newest version per account id.
* ``stg_opportunities`` CDC opportunities -> newest version, clean stage
                        name, soft-deleted rows dropped.
* ``incremental``       batches not consumed yet -> new slice merged with the
                        current snapshot -> new snapshot version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import EventSpec
from lakeloom.functions.contract import payload_field
from lakeloom.functions.text import clean_string
from lakeloom.operators import snapshot as SNAP
from lakeloom.operators.commit import RAW, committed, load_log, read_all
from lakeloom.operators.dedup import latest_by_key

# Dedup order for telemetry (newest load wins; file and position break ties).
EVENT_ORDER = ("_loaded_at", "_filename", "_pos")
ACCOUNT_ORDER = ("_fivetran_synced", "created_date")
OPPORTUNITY_ORDER = ("_fivetran_synced", "last_modified_date")

ACCOUNT_COLUMNS = ("account_id", "account_name", "industry", "arr", "billing_state",
                   "customer_tier", "created_date", "_fivetran_synced")
OPPORTUNITY_COLUMNS = ("opportunity_id", "account_id", "owner_id", "stage_name", "amount",
                       "close_date", "created_date", "last_modified_date", "is_deleted",
                       "_fivetran_synced")


def typed_events(raw: DataFrame, spec: EventSpec) -> DataFrame:
    """Contract-valid RAW rows with the payload typed late.

    Validity is the string-typed contract check done at load (``_reason`` is
    NULL), so JSON-null keys never reach staging.
    """
    valid = raw.where(F.col("_reason").isNull())
    cols = []
    for f in spec.staging_fields:
        if f.type == "timestamp_ntz":
            cols.append(payload_field(F.col("payload"), f.path, "string")
                        .try_cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(payload_field(F.col("payload"), f.path, f.type).alias(f.name))
    return valid.select(*cols, "_loaded_at", "_filename", "_pos", "_batch_id")


def stg_events(raw: DataFrame, spec: EventSpec) -> DataFrame:
    """Newest row per event id across files and loads."""
    return latest_by_key(typed_events(raw, spec), [spec.key_field], EVENT_ORDER)


def stg_accounts(accounts: DataFrame) -> DataFrame:
    """Only the columns the model depends on (a drifting replica may add more)."""
    return _newest(accounts.select(*ACCOUNT_COLUMNS), "account_id", ACCOUNT_ORDER)


def _newest(versions: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Newest version per key; versions that tie on the whole order are told apart by
    a hash of the row, so the choice doesn't depend on where a row lies."""
    hashed = versions.withColumn("_row_hash", F.xxhash64(*versions.columns))
    return latest_by_key(hashed, [key], [*order, "_row_hash"]).drop("_row_hash")


def stg_opportunities(opportunities: DataFrame) -> DataFrame:
    src = opportunities.select(*OPPORTUNITY_COLUMNS)
    return _live(_newest(src, "opportunity_id", OPPORTUNITY_ORDER))


def _live(latest: DataFrame) -> DataFrame:
    return (latest.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
            .withColumn("stage_name", clean_string(F.col("stage_name")))
            .drop("is_deleted"))


def stg_accounts_incremental(spark: SparkSession, snapshot_root: str, accounts: DataFrame, watermark: str) -> DataFrame:
    """``stg_accounts`` from the slices (``watermark``) that no build has consumed."""
    return _newest_incremental(spark, snapshot_root, accounts.select(*ACCOUNT_COLUMNS, watermark), "account_id", ACCOUNT_ORDER, watermark)


def stg_opportunities_incremental(spark: SparkSession, snapshot_root: str, opportunities: DataFrame, watermark: str) -> DataFrame:
    """``stg_opportunities`` from the slices that no build has consumed. The snapshot
    keeps deleted rows, which are dropped at read: an older version that arrives after
    a delete doesn't revive the row."""
    src = opportunities.select(*OPPORTUNITY_COLUMNS, watermark)
    return _live(_newest_incremental(spark, snapshot_root, src, "opportunity_id", OPPORTUNITY_ORDER, watermark))


def _newest_incremental(spark: SparkSession, snapshot_root: str, versions: DataFrame, key: str,
                        order: tuple[str, ...], watermark: str) -> DataFrame:
    own = [c for c in versions.columns if c != watermark]
    hashed = versions.withColumn("_row_hash", F.xxhash64(*own))
    out = build_incremental(spark, snapshot_root, hashed, [key], [*order, "_row_hash"], watermark=watermark)
    return out.select(*own)


# ------------------------------------------------------------- incremental

def current_snapshot(spark: SparkSession, snapshot_root: str) -> DataFrame | None:
    """The committed snapshot, or None before the first build."""
    return SNAP.current(spark, snapshot_root)


def build_incremental(spark: SparkSession, snapshot_root: str, source: DataFrame,
                      keys: list[str], order: list[str], *, watermark: str = "_batch_id",
                      full_refresh: bool = False, stream: str | None = None, epoch: int | None = None) -> DataFrame:
    """Latest-per-key model built incrementally (``operators/snapshot.py``).

    ``source`` holds typed rows carrying the ``watermark`` column (a batch id). The new
    slice is the rows of all ids that no build has consumed, whatever their order, so a
    batch that began earlier and was committed later is not lost. Only the buckets its
    keys fall into get new files. Because the newest-wins choice is associative, the
    result equals a full rebuild. ``full_refresh`` rebuilds from the whole source (needed
    after a logic change). ``stream`` and ``epoch`` name the micro-batch that asks.
    """
    return SNAP.merge(spark, snapshot_root, source, keys, order, watermark, full_refresh=full_refresh, stream=stream, epoch=epoch)


def stage_events(spark: SparkSession, spec: EventSpec, warehouse: str, snapshot_root: str, *,
                 stream: str | None = None, epoch: int | None = None, full_refresh: bool = False) -> DataFrame:
    """Event staging brought up to date with committed RAW; only the batches that no build
    has consumed are opened, if they can be named."""
    raw = committed(spark, warehouse, RAW)
    if not full_refresh:
        new = load_log(spark, warehouse).select("_batch_id").distinct().join(SNAP.consumed(spark, snapshot_root.rstrip("/"), "_batch_id"), "_batch_id", "left_anti")
        named = [r[0] for r in new.limit(SNAP.NAMED_IDS + 1).collect()]
        if len(named) <= SNAP.NAMED_IDS:
            raw = read_all(spark, warehouse, RAW).where(F.col("_batch_id").isin(named))
    raw = typed_events(raw, spec)
    return build_incremental(spark, snapshot_root, raw, [spec.key_field], list(EVENT_ORDER), full_refresh=full_refresh, stream=stream, epoch=epoch)
