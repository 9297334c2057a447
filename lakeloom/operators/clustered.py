"""RAW rows clustered by event time, so that a time window reads few files.

``cluster_raw`` copies the committed batches that no clustering holds yet into files
of neighbouring event times, and logs each file's least and greatest time last, which
commits the clustering. ``events_in_window`` reads the files whose range meets the
window, and filters the batches not clustered so far; its rows are those of the
committed RAW table, whatever is clustered. RAW itself isn't touched.

Under two clusterings at once a batch may be copied twice: the copy of the least
clustering id counts. A run that dies before the log leaves files nobody reads, and
the next run copies those batches anew. Rows without an event time lie in no window.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import commit as C

CLUSTERED = "raw_clustered"
CLUSTER_LOG = "raw_cluster_log"
CLUSTER_BATCHES = "raw_cluster_batches"
ID = "_cluster_id"
ROWS_PER_FILE = 1_000_000

_DATA = T.StructType(C.RAW_SCHEMA.fields + [T.StructField("_batch_id", T.StringType())])
_LOG = "file_name string, first_time timestamp_ntz, last_time timestamp_ntz, rows long"


def _table(spark: SparkSession, warehouse: str, table: str, schema: str) -> DataFrame:
    schema = f"{schema}, {ID} string"
    try:
        return spark.read.schema(schema).parquet(f"{warehouse.rstrip('/')}/{table}")
    except AnalysisException as e:
        if C.is_missing_path(e):
            return spark.createDataFrame([], schema)
        raise


def cluster_log(spark: SparkSession, warehouse: str) -> DataFrame:
    """Every file of the committed clusterings with its event-time range and rows."""
    return _table(spark, warehouse, CLUSTER_LOG, _LOG)


def clustered_batches(spark: SparkSession, warehouse: str) -> DataFrame:
    """(_batch_id, _cluster_id): the clustering that a batch is read from."""
    done = cluster_log(spark, warehouse).select(ID).distinct()
    return _table(spark, warehouse, CLUSTER_BATCHES, "_batch_id string").join(done, ID, "left_semi").groupBy(
        "_batch_id").agg(F.min(ID).alias(ID))


def cluster_raw(spark: SparkSession, warehouse: str, rows_per_file: int = ROWS_PER_FILE) -> str | None:
    """Cluster the batches not clustered so far; the clustering's id, or None if there
    is nothing to do. Files are ranges of (event time, event id), so a time that many
    rows share is split too. The number of files comes from the load log."""
    cluster, root = C.new_batch_id(C.run_timestamp()), warehouse.rstrip("/")
    sizes = C.load_log(spark, warehouse).groupBy("_batch_id").agg(F.sum("records_processed").alias("rows"))
    fresh = sizes.join(clustered_batches(spark, warehouse), "_batch_id", "left_anti").where("rows > 0")
    place = f"{root}/{CLUSTER_BATCHES}/{ID}={cluster}"
    fresh.write.parquet(place)
    fresh = spark.read.schema("_batch_id string, rows long").parquet(place)
    rows = fresh.agg(F.sum("rows")).first()[0]
    if not rows:
        return None
    data = C.read_all(spark, warehouse, C.RAW).join(fresh, "_batch_id", "left_semi").select(*_DATA.names)
    files = f"{root}/{CLUSTERED}/{ID}={cluster}"
    (data.repartitionByRange(math.ceil(rows / rows_per_file), "event_timestamp", "event_id")
         .sortWithinPartitions("event_timestamp", "event_id").write.parquet(files))
    (spark.read.schema(_DATA).parquet(files).groupBy(F.col("_metadata.file_name").alias("file_name"))
          .agg(F.min("event_timestamp").alias("first_time"), F.max("event_timestamp").alias("last_time"),
               F.count(F.lit(1)).alias("rows"))
          .coalesce(1).write.parquet(f"{root}/{CLUSTER_LOG}/{ID}={cluster}"))
    return cluster


def events_in_window(spark: SparkSession, warehouse: str, start: datetime, end: datetime) -> DataFrame:
    """Committed RAW rows with ``start <= event_timestamp < end``. Of the clustered
    files only those that can match are opened; their names pass the driver, as those
    of any scan do."""
    first, last, root = C.ts_literal(start), C.ts_literal(end), f"{warehouse.rstrip('/')}/{CLUSTERED}"
    hits = cluster_log(spark, warehouse).where((F.col("last_time") >= first) & (F.col("first_time") < last))
    paths = [f"{root}/{ID}={r[ID]}/{r['file_name']}" for r in hits.select(ID, "file_name").toLocalIterator()]
    batches = clustered_batches(spark, warehouse)
    open_batches = C.load_log(spark, warehouse).select("_batch_id").distinct().join(batches, "_batch_id", "left_anti")
    rows = C.read_all(spark, warehouse, C.RAW).join(open_batches, "_batch_id", "left_semi").select(*_DATA.names)
    if paths:
        schema = T.StructType(_DATA.fields + [T.StructField(ID, T.StringType())])
        held = spark.read.schema(schema).option("basePath", root).parquet(*paths)
        rows = rows.unionByName(held.join(batches, ["_batch_id", ID], "left_semi").select(*_DATA.names))
    return rows.where((F.col("event_timestamp") >= first) & (F.col("event_timestamp") < last))
