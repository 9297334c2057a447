"""File-arrival ingest: the unit of work stays one whole file; only the
trigger changes. A streaming ``text`` source (whole files) feeds
``foreachBatch``, which runs the same commit path as the batch loader, so the
load log stays the single idempotency record shared by batch and stream (a
file loaded by either is skipped by both). The checkpoint moves past a file that
failed, so every micro-batch writes its report and ``run_available_now`` first
tries the reported failures again (``retry_failed``).

With ``staging`` the stream goes on to the deduplicated staging table: each micro-batch
merges the batches of RAW that the snapshot has not consumed, newest row per event id.
The merge's commit row names the stream and the epoch, so a replayed micro-batch, after a
crash at any point, neither loses nor repeats a row.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import EventSpec
from lakeloom.functions.paths import file_uri_path, relative_path
from lakeloom.operators import commit as C
from lakeloom.plans.ingest import IngestError, WholeFiles, commit_contents, retry_failed
from lakeloom.plans.staging import stage_events
from lakeloom.sources.arrays import NOT_AN_ARRAY
from lakeloom.sources.landing import ScanScope, list_files


def ingest_stream(spark: SparkSession, spec: EventSpec, landing_root: str, warehouse: str,
                  checkpoint: str, *, available_now: bool = True, processing_time: str | None = None,
                  max_files_per_trigger: int | None = 1000, force: bool = False, staging: str | None = None, retry: bool = False):
    """Start the stream; with ``available_now`` it drains what is there and stops. With
    ``retry`` every micro-batch first tries the files again that have failed.
    ``staging``: snapshot folder of the deduplicated events, kept up to date."""
    # Folders are no partitions: a file outside the dt= folders lands too.
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(landing_root).select(
        relative_path(file_uri_path(F.col("_metadata.file_path")), landing_root).alias("_filename"),
        F.col("value"))

    def load_new(batch: DataFrame) -> None:
        todo = batch
        if not force:
            loaded = C.loaded_file_names(spark, warehouse)
            todo = batch.join(loaded, batch["_filename"] == loaded["file_name"], "left_anti")
        # A micro-batch is bounded (maxFilesPerTrigger); keep it for the passes below.
        todo = todo.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not todo.isEmpty():
                run_ts = C.run_timestamp()
                batch_id = C.new_batch_id(run_ts)
                names = F.broadcast if max_files_per_trigger else lambda files: files  # bounded, so texts aren't shuffled
                source = WholeFiles(spec, lambda files: todo.join(names(files.select("_filename")), "_filename", "left_semi"))
                report = commit_contents(spark, spec, warehouse, source, run_ts=run_ts, batch_id=batch_id,
                                         attempted=todo.select("_filename", F.col("_filename").alias("path")))
                C.write_batch(report, warehouse, C.RUN_REPORT, batch_id)
        finally:
            todo.unpersist()

    def load_batch(batch: DataFrame, epoch_id: int) -> None:
        if retry:
            retry_failed(spark, spec, landing_root, warehouse)
        with C.claim(spark, warehouse):
            load_new(batch)
        if staging:
            stage_events(spark, spec, warehouse, staging, stream=checkpoint, epoch=epoch_id)

    writer = stream.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_available_now(spark: SparkSession, spec: EventSpec, landing_root: str, warehouse: str,
                      checkpoint: str, **kw) -> None:
    """Retry the files that failed earlier, then drain what has arrived."""
    retry_failed(spark, spec, landing_root, warehouse)
    run_stream(ingest_stream(spark, spec, landing_root, warehouse, checkpoint, available_now=True, **kw))
    report_empty_files(spark, landing_root, warehouse)
    if staging := kw.get("staging"):  # also takes what the retry loaded, if no file has arrived
        stage_events(spark, spec, warehouse, staging)


def report_empty_files(spark: SparkSession, landing_root: str, warehouse: str) -> None:
    """Report files of 0 bytes, of which a stream gets no row, as failed (once each)."""
    none = list_files(spark, landing_root, ScanScope.backfill()).where("length = 0").select(F.col("_filename").alias("file_name"))
    new = none.join(C.read_all(spark, warehouse, C.RUN_REPORT).select("file_name"), "file_name", "left_anti")
    if not new.isEmpty():
        zero = F.lit(0).cast("long")
        rows = new.select("file_name", F.lit("failed").alias("status"), F.lit(NOT_AN_ARRAY).alias("detail"), zero.alias("records_processed"), zero.alias("records_quarantined"))
        C.write_batch(rows, warehouse, C.RUN_REPORT, C.new_batch_id(C.run_timestamp()))


def file_verdicts(spark: SparkSession, warehouse: str) -> DataFrame:
    """(file_name, status, detail): loaded if the log holds the file, else its last report."""
    last = C.read_all(spark, warehouse, C.RUN_REPORT).where("status <> 'skipped'").groupBy("file_name").agg(
        F.max_by(F.struct("status", "detail"), "_batch_id").alias("last"))
    held = C.loaded_file_names(spark, warehouse).withColumn("held", F.lit(True))
    held = held.join(last, "file_name", "full").withColumn("held", F.coalesce("held", F.lit(False)))
    return held.select("file_name", F.when(F.col("held"), "loaded").otherwise(F.col("last.status")).alias("status"),
                       F.when(~F.col("held"), F.col("last.detail")).alias("detail"))


def run_stream(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise IngestError(str(query.exception()))


def failed_files(spark: SparkSession, warehouse: str) -> DataFrame:
    """(file_name) of files that a report calls failed and no load log holds."""
    failed = C.read_all(spark, warehouse, C.RUN_REPORT).where("status = 'failed'").select("file_name").distinct()
    return failed.join(C.loaded_file_names(spark, warehouse), "file_name", "left_anti")
