"""Telemetry load: list -> prune -> skip loaded -> scan -> explode -> validate
-> RAW + quarantine + load log (committed per batch).

Set-based: one Spark job parses every file in scope; each file gets a verdict.
A file that is not a JSON array (or, with ``strict``, has an unparsable
timestamp) is excluded whole: no rows, no log row, so the next run retries it.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import EventSpec
from lakeloom.functions.contract import contract_reason, invalid_timestamp, promoted
from lakeloom.operators import commit as C
from lakeloom.sources.arrays import NOT_AN_ARRAY, STRICT_TS, SplitArrays, read_fragments
from lakeloom.sources.landing import ScanScope, list_files, read_contents

# Fixed value: the verdict on a file without elements.
EMPTY_ARRAY = "empty array (no rows; rescanned next run)"


log = logging.getLogger("lakeloom.ingest")


@contextmanager
def _phase(name: str):
    t = time.perf_counter()
    yield
    log.info("%s %.3fs", name, time.perf_counter() - t)


class IngestError(RuntimeError):
    pass


@dataclass
class IngestResult:
    batch_id: str | None   # the run id (also the first batch), None when nothing was loaded
    run_ts: datetime
    report: DataFrame      # file_name, status, detail, records_processed, records_quarantined
    batches: tuple[str, ...] = ()

    def totals(self) -> DataFrame:
        """Run totals: files loaded, rows loaded, rows quarantined."""
        loaded = self.report.where(F.col("status") == "loaded")
        return loaded.agg(
            F.count(F.lit(1)).alias("files_loaded"),
            F.coalesce(F.sum("records_processed"), F.lit(0)).cast("long").alias("rows_loaded"),
            F.coalesce(F.sum("records_quarantined"), F.lit(0)).cast("long").alias("rows_quarantined"),
        )


def _report_rows(df: DataFrame, status: str, detail) -> DataFrame:
    return df.select(
        F.col("_filename").alias("file_name"),
        F.lit(status).alias("status"),
        (detail if not isinstance(detail, str) else F.lit(detail)).cast("string").alias("detail"),
        F.lit(0).cast("long").alias("records_processed"),
        F.lit(0).cast("long").alias("records_quarantined"),
    )


def raw_rows(spec: EventSpec, records: DataFrame, run_ts: datetime) -> DataFrame:
    """(_filename, _pos, payload) -> RAW rows: promoted keys, lineage, reason.

    The full set lands, valid or not; ``_reason`` is NULL for valid records.
    """
    p = F.col("payload")
    keys = dict.fromkeys([spec.key_field, spec.account_field, spec.timestamp_field, *spec.required])
    # A projection of its own, so each key is looked up once a record.
    found = records.select("payload", "_filename", "_pos", *[promoted(p, k).alias(f"_key_{n}") for n, k in enumerate(keys)])
    values = {k: F.col(f"_key_{n}") for n, k in enumerate(keys)}
    return found.select(
        values[spec.key_field].alias("event_id"),
        values[spec.account_field].alias("account_id"),
        values[spec.timestamp_field].try_cast("timestamp_ntz").alias("event_timestamp"),
        p,
        F.col("_filename"),
        F.col("_pos").cast("int").alias("_pos"),
        C.ts_literal(run_ts).alias("_loaded_at"),
        contract_reason(values, spec.required, spec.timestamp_field).alias("_reason"),
    )


class WholeFiles:
    """Files parsed whole, one row a file. ``read`` gives (_filename, value) of the files
    (path, _filename) named."""

    def __init__(self, spec: EventSpec, read: Callable[[DataFrame], DataFrame], strict: bool = False):
        self.spec, self.read, self.strict = spec, read, strict

    def _parsed(self, files: DataFrame) -> DataFrame:
        parsed = self.read(files).select("_filename", F.from_json("value", "array<variant>").alias("_records"))
        error = F.when(F.col("_records").isNull(), F.lit(NOT_AN_ARRAY))
        if self.strict:
            error = error.when(
                F.exists("_records", lambda r: invalid_timestamp(r, self.spec.timestamp_field)), F.lit(STRICT_TS))
        return parsed.select("_filename", "_records", error.alias("_file_error"))

    def records(self, files: DataFrame) -> DataFrame:
        """(_filename, _pos, payload) of the files without an error."""
        parsed = self._parsed(files)
        # Each file is parsed once: filters on the error, and those that Spark infers for an
        # inner explode, would be pushed down to the scan and parse it again for each.
        records = F.when(F.col("_file_error").isNull(), F.col("_records")) if self.strict else F.col("_records")
        return parsed.select("_filename", F.posexplode_outer(records).alias("_pos", "payload")).where("_pos IS NOT NULL")

    def errors(self, files: DataFrame) -> DataFrame:
        """(_filename, _file_error), the error null for ``[]``."""
        return self._parsed(files).select("_filename", "_file_error")


def commit_contents(spark: SparkSession, spec: EventSpec, warehouse: str, source, *,
                    run_ts: datetime, batch_id: str, attempted: DataFrame) -> DataFrame:
    """Parse, validate and commit the ``attempted`` files (path, _filename) as one batch.

    ``source`` (``WholeFiles`` or ``SplitArrays``) parses them. One pass writes RAW;
    quarantine and log derive from the written batch. Files that produced no log row (not
    a JSON array, strict failure, or ``[]``) are the attempted ones without a row in the
    batch's log; they alone are parsed a second time, to report why. Returns the per-file
    report rows of this batch.
    """
    records = source.records(attempted)
    with _phase("write raw"):
        C.write_batch(raw_rows(spec, records, run_ts), warehouse, C.RAW, batch_id)

    raw = C.read_batch(spark, warehouse, C.RAW, batch_id)
    quarantine = raw.where(F.col("_reason").isNotNull()).select(
        F.col("_reason").alias("reason"), "payload", "_filename", "_pos",
        C.ts_literal(run_ts).alias("_quarantined_at"))
    with _phase("write quarantine"):
        C.write_batch(quarantine, warehouse, C.QUARANTINE, batch_id)
    log = raw.groupBy("_filename").agg(
        F.count(F.lit(1)).alias("records_processed"),
        F.count_if(F.col("_reason").isNotNull()).alias("records_quarantined"),
    ).select(F.col("_filename").alias("file_name"), "records_processed", "records_quarantined",
             C.ts_literal(run_ts).alias("load_timestamp"))
    with _phase("write load log"):
        C.write_batch(log, warehouse, C.LOAD_LOG, batch_id)  # commit marker, written last

    loaded = C.read_batch(spark, warehouse, C.LOAD_LOG, batch_id).select(
        "file_name", F.lit("loaded").alias("status"), F.lit(None).cast("string").alias("detail"),
        "records_processed", "records_quarantined")
    missing = attempted.join(loaded.select(F.col("file_name").alias("_filename")), "_filename", "left_anti")
    if missing.isEmpty():
        return loaded
    why = source.errors(missing).select("_filename", F.coalesce("_file_error", F.lit(EMPTY_ARRAY)).alias("detail"))
    # a file of 0 bytes makes no row at all: it is no array either
    why = missing.select("_filename").join(why, "_filename", "left").select(
        F.col("_filename").alias("file_name"), F.coalesce("detail", F.lit(NOT_AN_ARRAY)).alias("detail"))
    status = F.when(F.col("detail") == EMPTY_ARRAY, "empty").otherwise("failed")
    zero = F.lit(0).cast("long")
    return loaded.unionByName(why.select("file_name", status.alias("status"), "detail", zero.alias("records_processed"), zero.alias("records_quarantined")))


def ingest(spark: SparkSession, spec: EventSpec, landing_root: str, warehouse: str,
           scope: ScanScope | None = None, *, force: bool = False, strict: bool = False,
           run_ts: datetime | None = None, dry_run: bool = False, only: DataFrame | None = None,
           persist_report: bool = False, split_arrays: bool = False, wait: float = 3600.0) -> IngestResult:
    """Load every file in scope that is not yet in the load log (all of them
    with ``force``) and return the per-file run report. ``dry_run`` reports
    what would be loaded and writes nothing. ``only`` (file_name) narrows the
    scope to the files named.

    The scope is listed once: the files and whether the log held them at that
    time are written as the run's manifest (if anything is to load), from which the
    paths to read and the report come, so the report is the same however late it is
    evaluated. A run is one commit at any number of files; no list of files beyond
    Spark's own index and no payload passes through the driver. ``split_arrays``
    reads each array by byte ranges (``sources/arrays.py``) instead of one row a file.
    ``persist_report`` also writes the report to the ``run_report`` table.

    From the look at the load log to the commit the run holds the warehouse's claim, so
    of two runs over one scope the later one waits (up to ``wait`` seconds) and skips what
    the first has loaded.
    """
    with nullcontext() if dry_run else C.claim(spark, warehouse, wait):
        return _ingest(spark, spec, landing_root, warehouse, scope, force, strict, run_ts, dry_run, only, persist_report, split_arrays)


def _ingest(spark: SparkSession, spec: EventSpec, landing_root: str, warehouse: str, scope: ScanScope | None, force: bool, strict: bool,
            run_ts: datetime | None, dry_run: bool, only: DataFrame | None, persist_report: bool, split_arrays: bool) -> IngestResult:
    scope = scope or ScanScope.window(lookback_hours=spec.lookback_hours)
    run_ts = run_ts or C.run_timestamp()
    run_id = C.new_batch_id(run_ts)
    files = list_files(spark, landing_root, scope).select("path", "_filename")
    if only is not None:
        files = files.join(only.select(F.col("file_name").alias("_filename")).distinct(), "_filename", "left_semi")
    if force:
        manifest = files.withColumn("held", F.lit(False))
    else:
        held = C.loaded_file_names(spark, warehouse).select(F.col("file_name").alias("_filename")).distinct().withColumn("held", F.lit(True))
        manifest = files.join(held, "_filename", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    loads = not dry_run and not manifest.where("not held").isEmpty()
    if loads:
        path = f"{warehouse.rstrip('/')}/_manifests/{run_id}"
        with _phase("list + skip"):
            manifest.write.parquet(path)
        manifest = spark.read.schema(manifest.schema).parquet(path)
    todo = manifest.where("not held")
    parts = [_report_rows(manifest.where("held"), "skipped", "already loaded")]
    if dry_run:
        parts.append(_report_rows(todo, "would load", scope.mode))
        return IngestResult(None, run_ts, _union(parts))

    if loads:
        if split_arrays:
            source = SplitArrays(spec, lambda files: read_fragments(spark, landing_root, scope, files), strict)
        else:
            source = WholeFiles(spec, lambda files: read_contents(spark, landing_root, scope, files), strict)
        parts.append(commit_contents(spark, spec, warehouse, source, run_ts=run_ts, batch_id=run_id, attempted=todo.select("path", "_filename")))
    report = _union(parts)
    if loads and persist_report:  # reading it back also cuts lineage
        with _phase("write report"):
            C.write_batch(report, warehouse, C.RUN_REPORT, run_id)
        report = C.read_batch(spark, warehouse, C.RUN_REPORT, run_id).drop("_batch_id")
    if strict:  # after the good files committed
        bad = report.where(F.col("status") == "failed")
        if n := bad.count():
            first = bad.orderBy("file_name").first()
            raise IngestError(f"{n} file(s) failed, the first is {first.file_name}: {first.detail}; "
                              "the run report names all")
    return IngestResult(run_id if loads else None, run_ts, report, (run_id,) if loads else ())


def retry_failed(spark: SparkSession, spec: EventSpec, landing_root: str, warehouse: str) -> IngestResult | None:
    """Try the files again that a run report calls failed and no load log holds."""
    reports = C.read_all(spark, warehouse, C.RUN_REPORT)
    if reports is None:
        return None
    failed = reports.where("status = 'failed'").select("file_name").distinct().join(
        C.loaded_file_names(spark, warehouse).select("file_name").distinct(), "file_name", "left_anti")
    if failed.isEmpty():
        return None
    return ingest(spark, spec, landing_root, warehouse, ScanScope.backfill(), only=failed, persist_report=True)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
