"""Append-only tables with an atomic per-batch commit on plain Parquet.

Every load run gets a unique ``_batch_id``. RAW and quarantine rows are written
under ``<table>/_batch_id=<id>/``; the load-log rows of the batch are written
last and are the commit marker. ``committed()`` semi-joins a table to the
batches present in the log, so a run that dies between writes leaves invisible
orphans, never half a file. A retry uses a new batch id.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "raw"
QUARANTINE = "quarantine"
LOAD_LOG = "load_log"
RUN_REPORT = "run_report"

_BATCH = T.StructField("_batch_id", T.StringType())

RAW_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("event_timestamp", T.TimestampNTZType()),
    T.StructField("payload", T.VariantType()),
    T.StructField("_filename", T.StringType()),
    T.StructField("_pos", T.IntegerType()),
    T.StructField("_loaded_at", T.TimestampNTZType()),
    T.StructField("_reason", T.StringType()),
])

QUARANTINE_SCHEMA = T.StructType([
    T.StructField("reason", T.StringType()),
    T.StructField("payload", T.VariantType()),
    T.StructField("_filename", T.StringType()),
    T.StructField("_pos", T.IntegerType()),
    T.StructField("_quarantined_at", T.TimestampNTZType()),
])

LOAD_LOG_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("records_processed", T.LongType()),
    T.StructField("records_quarantined", T.LongType()),
    T.StructField("load_timestamp", T.TimestampNTZType()),
])

RUN_REPORT_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("records_processed", T.LongType()),
    T.StructField("records_quarantined", T.LongType()),
])

#: Seconds between the signs of life of a claim's holder, and without one after which the
#: claim counts as left behind by a run that died.
SIGN_OF_LIFE, LEFT_BEHIND = 30.0, 600.0

SCHEMAS = {RAW: RAW_SCHEMA, QUARANTINE: QUARANTINE_SCHEMA, LOAD_LOG: LOAD_LOG_SCHEMA,
           RUN_REPORT: RUN_REPORT_SCHEMA}


def new_batch_id(run_ts: datetime) -> str:
    """Time-sortable, unique batch id (letters keep it a string partition value)."""
    return f"b{run_ts:%Y%m%dT%H%M%S%f}x{uuid.uuid4().hex[:10]}"


def run_timestamp() -> datetime:
    """One CURRENT_TIMESTAMP per run (UTC wall clock), shared by all its rows."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def ts_literal(ts: datetime) -> Column:
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def batch_path(warehouse: str, table: str, batch_id: str) -> str:
    return f"{warehouse.rstrip('/')}/{table}/_batch_id={batch_id}"


def write_batch(df: DataFrame, warehouse: str, table: str, batch_id: str) -> None:
    """Write one batch of a table; an existing batch folder is an error."""
    df.write.mode("errorifexists").parquet(batch_path(warehouse, table, batch_id))


class Claimed(RuntimeError):
    """Another run holds the warehouse's claim."""


class _ClaimFile:
    """One file of the shared file system, made only if it is not there."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(f"{warehouse.rstrip('/')}/_claims/load")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path.getParent())

    def made(self) -> bool:
        if self.fs.getScheme() == "file":  # its create() looks first and makes then
            return self.jvm.java.io.File(self.path.toUri().getPath()).createNewFile()
        try:
            self.fs.create(self.path, False).close()
        except Exception:  # noqa: BLE001 - whoever made it first has it; other faults show as well
            if self.touched() is None:
                raise
            return False
        return True

    def touched(self) -> int | None:
        """Time of the holder's last sign of life, in milliseconds; None without a claim."""
        found = self.fs.globStatus(self.path)
        return found[0].getModificationTime() if found else None

    def sign(self) -> None:
        self.fs.setTimes(self.path, int(time.time() * 1000), -1)

    def cleared(self, seen: int) -> None:
        """Put a claim aside that shows no sign of life since ``seen``."""
        if self.touched() == seen:
            aside = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}-{uuid.uuid4().hex}")
            if self.fs.rename(self.path, aside):
                self.fs.delete(aside, False)


@contextmanager
def claim(spark: SparkSession, warehouse: str, wait: float = 3600.0) -> Iterator[None]:
    """Hold the warehouse for one load, from the look at the load log to the commit, so two
    runs over one scope don't both load its files: the later one waits up to ``wait``
    seconds (then ``Claimed`` is raised) and finds them in the log.

    The claim is a file that is made only if it is not there. Its holder renews the time
    of the file; a claim without a sign of life for ``LEFT_BEHIND`` seconds comes from a
    run that died and is put aside.
    """
    file, until = _ClaimFile(spark, warehouse), time.monotonic() + wait
    while not file.made():
        seen = file.touched()
        if seen is not None and time.time() * 1000 - seen > LEFT_BEHIND * 1000:
            file.cleared(seen)
        elif time.monotonic() >= until:
            raise Claimed(f"another run loads into {warehouse}")
        else:
            time.sleep(min(0.5, max(0.01, until - time.monotonic())))
    done = threading.Event()

    def renew() -> None:
        while not done.wait(SIGN_OF_LIFE):
            file.sign()

    renewing = threading.Thread(target=renew, daemon=True)
    renewing.start()
    try:
        yield
    finally:
        done.set()
        renewing.join()
        file.fs.delete(file.path, False)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, as a relation that Spark knows to be small (joins broadcast it)."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def is_missing_path(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error)


def read_all(spark: SparkSession, warehouse: str, table: str) -> DataFrame:
    """Every batch of a table, committed or not, with its ``_batch_id``."""
    schema = T.StructType(SCHEMAS[table].fields + [_BATCH])
    try:
        return spark.read.schema(schema).parquet(f"{warehouse.rstrip('/')}/{table}")
    except AnalysisException as e:
        if is_missing_path(e):
            return empty(spark, schema)
        raise


def read_batch(spark: SparkSession, warehouse: str, table: str, batch_id: str) -> DataFrame:
    return (spark.read.schema(SCHEMAS[table]).parquet(batch_path(warehouse, table, batch_id))
            .withColumn("_batch_id", F.lit(batch_id)))


def load_log(spark: SparkSession, warehouse: str) -> DataFrame:
    """The load log; its rows exist only for committed batches."""
    return read_all(spark, warehouse, LOAD_LOG)


def committed(spark: SparkSession, warehouse: str, table: str) -> DataFrame:
    """Rows of committed batches only (semi-join to the batches in the log).

    The batch list has one row per run; Spark broadcasts it while it is small.
    """
    data = read_all(spark, warehouse, table)
    if table in (LOAD_LOG, RUN_REPORT):  # the log is the marker; reports are written after commit
        return data
    batches = load_log(spark, warehouse).select("_batch_id").distinct()
    return data.join(batches, "_batch_id", "left_semi")


def loaded_file_names(spark: SparkSession, warehouse: str) -> DataFrame:
    return load_log(spark, warehouse).select(F.col("file_name")).distinct()


def events_between(raw: DataFrame, start, end) -> DataFrame:
    """Event-time range on the promoted column (Parquet statistics prune row
    groups); the payload path itself is never filtered."""
    return raw.where((F.col("event_timestamp") >= F.lit(start).cast("timestamp_ntz")) &
                     (F.col("event_timestamp") < F.lit(end).cast("timestamp_ntz")))


def register_views(spark: SparkSession, warehouse: str, prefix: str = "") -> list[str]:
    """Expose the committed tables to Spark SQL as temp views
    (``raw``, ``quarantine``, ``load_log``, ``run_report``)."""
    names = []
    for table in (RAW, QUARANTINE, LOAD_LOG, RUN_REPORT):
        committed(spark, warehouse, table).createOrReplaceTempView(prefix + table)
        names.append(prefix + table)
    return names
