"""Keyed snapshot on plain Parquet: a merge writes its own rows, to the buckets it meets.

Rows lie in hash buckets of their key, and every bucket has its own versions:

    <root>/data/_version=<id>/_bucket=<n>/...   rows of the buckets that merge met
    <root>/touched/_version=<id>/               their numbers, how many rows, whether whole
    <root>/consumed/_version=<id>/              the source ids that merge consumed
    <root>/commits/                             one row a merge, written last

A merge is visible by its one commit row; a run that dies before it leaves files that no
reader takes. The current snapshot is, for each bucket, the newest row per key of its
newest whole version and the increments since. Once a bucket's increments hold more than
``GROWN`` times its whole version's rows (or are more than ``INCREMENTS``), it is written
whole again, in a commit of its own: so what merges write grows with what they bring, not
with the snapshot each time. Source ids are kept as increments, too.

A merge may carry (stream, epoch). A stream's epoch that a commit row already names is
done: replaying the micro-batch changes nothing. Merges of one root come from one writer
at a time.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.commit import is_missing_path
from lakeloom.operators.dedup import latest_by_key

COMMITS = "version long, buckets int, full boolean, stream string, epoch long, keys array<string>, newest_by array<string>"
#: Buckets of a new snapshot; a snapshot keeps its number. One bucket should be what a few tasks rewrite.
BUCKETS = 64
BUCKET, VERSION = "_bucket", "_version"
TOUCHED = f"{BUCKET} int, rows long, whole boolean, {VERSION} long"
#: A bucket is written whole when its increments hold more than so many times the rows of
#: its whole version, or when they are more than so many.
GROWN, INCREMENTS = 2, 16
#: Up to so many source ids are named in a filter, by which Spark leaves out the other partitions.
NAMED_IDS = 1000


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if is_missing_path(e):
            return None
        raise


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row a merge: version, buckets, full, stream, epoch."""
    found = _read(spark, f"{root}/commits", COMMITS)
    return spark.createDataFrame([], COMMITS) if found is None else found


def _live(spark: SparkSession, root: str) -> tuple[int | None, DataFrame]:
    """The number of buckets and the committed versions since the last full build."""
    done = commits(spark, root).persist()
    try:
        last = done.agg(F.max_by("buckets", "version").alias("buckets"), F.max(F.when(F.col("full"), F.col("version"))).alias("since")).first()
    finally:
        done.unpersist()
    since = F.lit(last.since if last.since is not None else 0)
    return last.buckets, commits(spark, root).where(F.col("version") >= since).select(F.col("version").alias(VERSION))


def consumed(spark: SparkSession, root: str, watermark: str, kind: str = "string") -> DataFrame:
    """The source ids of all committed merges since the last full build."""
    ids = _read(spark, f"{root}/consumed", f"`{watermark}` {kind}, {VERSION} long")
    if ids is None:
        return spark.createDataFrame([], f"`{watermark}` {kind}")
    return ids.join(_live(spark, root)[1], VERSION, "left_semi").select(watermark)


def _parts(spark: SparkSession, root: str) -> list[Row]:
    """(bucket, version, rows, whole) of the current buckets, the whole version first; at
    most ``INCREMENTS`` + 2 rows a bucket reach the driver."""
    touched = _read(spark, f"{root}/touched", TOUCHED)
    if touched is None:
        return []
    live = touched.join(_live(spark, root)[1], VERSION, "left_semi").withColumn("whole", F.coalesce("whole", F.lit(True)))
    since = F.max(F.when(F.col("whole"), F.col(VERSION))).over(Window.partitionBy(BUCKET))
    return live.withColumn("_since", F.coalesce(since, F.lit(0))).where(F.col(VERSION) >= F.col("_since")).orderBy(BUCKET, VERSION).collect()


def _folder(root: str, part: Row) -> str:
    return f"{root}/data/{VERSION}={part[VERSION]}/{BUCKET}={part[BUCKET]}"


def _rows(spark: SparkSession, root: str, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*folders)


def _schema_at(spark: SparkSession, folder: str):
    return spark.read.parquet(folder).schema


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot as of the last commit; None before the first."""
    root = root.rstrip("/")
    parts = _parts(spark, root)
    return _newest(spark, root, parts, _schema_at(spark, _folder(root, parts[0]))).drop(BUCKET, VERSION) if parts else None


def _newest(spark: SparkSession, root: str, parts: list[Row], schema) -> DataFrame:
    """The newest row per key of the parts; buckets of one part hold a key once."""
    times = Counter(p[BUCKET] for p in parts)
    alone, several = ([_folder(root, p) for p in parts if (times[p[BUCKET]] > 1) is more] for more in (False, True))
    if not several:
        return _rows(spark, root, alone, schema)
    rows = _rows(spark, root, several, schema)
    by = commits(spark, root).where("keys IS NOT NULL").agg(F.max_by(F.struct("keys", "newest_by"), "version").alias("by")).first().by
    rows = latest_by_key(rows, by["keys"], by["newest_by"]).select(*rows.columns)
    return rows.unionByName(_rows(spark, root, alone, schema)) if alone else rows


def files_by_bucket(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, file) of the current snapshot."""
    root = root.rstrip("/")
    folders = [_folder(root, p) for p in _parts(spark, root)]
    rows = _rows(spark, root, folders, _schema_at(spark, folders[0]))
    return rows.select(F.regexp_extract("_metadata.file_path", rf"{BUCKET}=(\d+)", 1).cast("int").alias("bucket"),
                       F.col("_metadata.file_path").alias("file")).distinct()


def done_epoch(spark: SparkSession, root: str, stream: str, epoch: int) -> bool:
    return not commits(spark, root.rstrip("/")).where((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, root: str, version: int, buckets: int, full: bool, stream: str | None, epoch: int | None,
            keys: Sequence[str], order: Sequence[str]) -> None:
    row = (version, buckets, full, stream, epoch, list(keys), list(order))
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _new_version() -> int:
    return time.time_ns() // 1000 * 1000 + uuid.uuid4().int % 1000


def _write(spark: SparkSession, root: str, version: int, rows: DataFrame, whole: bool) -> None:
    """The rows (with their bucket) as one version, and what it touched."""
    path = f"{root}/data/{VERSION}={version}"
    # A bucket goes to one task, or to several where it is large (AQE splits the rebalanced ones).
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
    counts = spark.read.schema(rows.schema).parquet(path).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"))
    counts.withColumn("whole", F.lit(whole)).coalesce(1).write.parquet(f"{root}/touched/{VERSION}={version}")


def compact(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Write the buckets whole whose increments have grown."""
    parts = _parts(spark, root)
    by_bucket = {b: [p for p in parts if p[BUCKET] == b] for b in {p[BUCKET] for p in parts}}
    grown = [p for own in by_bucket.values() for p in own
             if len(own) > INCREMENTS + 1 or len(own) > 1 and sum(q["rows"] for q in own[1:]) > GROWN * (own[0]["rows"] or 0)]
    if not grown:
        return
    version, buckets = _new_version(), _live(spark, root)[0]
    rows = _newest(spark, root, grown, _schema_at(spark, _folder(root, grown[0]))).drop(VERSION)
    _write(spark, root, version, rows, True)
    _commit(spark, root, version, buckets, False, None, None, keys, order)


def merge(spark: SparkSession, root: str, source: DataFrame, keys: Sequence[str], order: Sequence[str], watermark: str, *,
          full_refresh: bool = False, buckets: int = BUCKETS, stream: str | None = None, epoch: int | None = None) -> DataFrame:
    """Merge the rows of ``source`` whose ``watermark`` id no merge has consumed: the
    newest row per key wins, among them and against the current rows.

    ``full_refresh`` rebuilds all buckets from the whole source. A null id ends the
    job with an error, as such a row could never be consumed. Returns the snapshot.
    """
    root = root.rstrip("/")
    if stream is not None and done_epoch(spark, root, stream, epoch):
        return current(spark, root)
    kept, live = _live(spark, root)
    full = full_refresh or kept is None
    buckets = buckets if kept is None else kept
    version = _new_version()
    checked = F.when(F.col(watermark).isNull(), F.raise_error(F.lit(f"null {watermark}"))).otherwise(F.col(watermark))
    rows = source.withColumn(watermark, checked)
    ids = rows.select(watermark).distinct()
    if not full:
        ids = ids.join(consumed(spark, root, watermark, source.schema[watermark].dataType.simpleString()), watermark, "left_anti")
    mine = f"{VERSION}={version}"
    ids.write.parquet(f"{root}/consumed/{mine}")
    fresh = spark.read.schema(ids.schema).parquet(f"{root}/consumed/{mine}")
    if not full and fresh.isEmpty():  # nothing to merge, nothing to commit
        return current(spark, root)
    named = [r[0] for r in fresh.limit(NAMED_IDS + 1).collect()]
    if len(named) <= NAMED_IDS:
        slice_ = source.where(F.col(watermark).isin(named))
    else:
        slice_ = rows.join(fresh, watermark, "left_semi").select(*source.columns)
    result = latest_by_key(slice_, list(keys), list(order)).withColumn(BUCKET, bucket_of(keys, buckets))
    _write(spark, root, version, result, full)
    _commit(spark, root, version, buckets, full, stream, epoch, keys, order)
    if not full:
        compact(spark, root, keys, order)
    out = current(spark, root)
    return spark.createDataFrame([], source.schema) if out is None else out.select(*source.columns)
