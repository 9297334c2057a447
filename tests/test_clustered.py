"""Event-time windows over clustered RAW: the rows of committed RAW, from few files."""

from datetime import datetime

from pyspark.sql import functions as F

from lakeloom.operators import clustered as K
from lakeloom.operators import commit as C


def _batch(spark, wh, batch, first, n, null_every=7):
    """A committed batch of n rows, a minute apart from minute ``first``."""
    rows = spark.range(n).select(
        F.concat(F.lit(f"{batch}-"), F.col("id").cast("string")).alias("event_id"), F.lit("a").alias("account_id"),
        F.when(F.col("id") % null_every != 0, F.expr(f"timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,{first} + id)"))
         .alias("event_timestamp"),
        F.parse_json(F.lit('{"k": 1}')).alias("payload"), F.lit("f").alias("_filename"), F.col("id").cast("int").alias("_pos"),
        F.expr("timestamp_ntz'2024-02-01'").alias("_loaded_at"), F.lit(None).cast("string").alias("_reason"))
    C.write_batch(rows, wh, C.RAW, batch)
    return n


def _log(spark, wh, batch, n):
    log = spark.createDataFrame([("f", n, 0, datetime(2024, 2, 1))], C.LOAD_LOG_SCHEMA)
    C.write_batch(log, wh, C.LOAD_LOG, batch)


def _ids(df):
    return sorted(r[0] for r in df.select("event_id").collect())


WINDOWS = [(datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2)), (datetime(2023, 1, 1), datetime(2025, 1, 1)),
           (datetime(2024, 1, 1, 3, 5), datetime(2024, 1, 1, 3, 5)), (datetime(2030, 1, 1), datetime(2031, 1, 1)),
           (datetime(2024, 1, 1, 0, 1), datetime(2024, 1, 1, 0, 2))]


def _same(spark, wh):
    for start, end in WINDOWS:
        want = C.events_between(C.committed(spark, wh, C.RAW), start, end)
        got = K.events_in_window(spark, wh, start, end)
        assert _ids(got) == _ids(want), (start, end)
        assert got.columns == K._DATA.names


def test_windows_hold_the_committed_rows(spark, tmp_path):
    wh = str(tmp_path)
    assert K.cluster_raw(spark, wh) is None
    assert K.events_in_window(spark, wh, *WINDOWS[1]).count() == 0
    for i, batch in enumerate(["b1", "b2"]):
        _log(spark, wh, batch, _batch(spark, wh, batch, 60 * i, 300))
    _batch(spark, wh, "lost", 0, 50)  # never committed
    _same(spark, wh)
    assert K.cluster_raw(spark, wh, rows_per_file=50) is not None
    _same(spark, wh)
    _log(spark, wh, "b3", _batch(spark, wh, "b3", 30, 100))  # committed later, not clustered yet
    _same(spark, wh)
    assert K.cluster_raw(spark, wh, rows_per_file=50) is not None
    assert K.cluster_raw(spark, wh, rows_per_file=50) is None
    _same(spark, wh)


def test_a_window_opens_few_files(spark, tmp_path):
    wh = str(tmp_path)
    _log(spark, wh, "b1", _batch(spark, wh, "b1", 0, 1000))
    K.cluster_raw(spark, wh, rows_per_file=50)
    log = K.cluster_log(spark, wh).collect()
    assert len(log) >= 15 and sum(r.rows for r in log) == 1000
    files = [f for f in K.events_in_window(spark, wh, *WINDOWS[0]).inputFiles() if K.CLUSTERED + "/" in f]
    assert 1 <= len(files) <= 4


def test_a_time_that_many_rows_share_is_split(spark, tmp_path):
    wh = str(tmp_path)
    _batch(spark, wh, "b1", 0, 600, null_every=1)  # all without a time
    _log(spark, wh, "b1", 600)
    K.cluster_raw(spark, wh, rows_per_file=100)
    assert max(r.rows for r in K.cluster_log(spark, wh).collect()) < 300
    _same(spark, wh)


def test_two_clusterings_at_once_and_one_that_died(spark, tmp_path, monkeypatch):
    wh = str(tmp_path)
    _log(spark, wh, "b1", _batch(spark, wh, "b1", 0, 200))
    none = spark.createDataFrame([], "_batch_id string, _cluster_id string")
    with monkeypatch.context() as m:  # both begin before either has committed
        m.setattr(K, "clustered_batches", lambda *_: none)
        K.cluster_raw(spark, wh, rows_per_file=50)
        K.cluster_raw(spark, wh, rows_per_file=30)
    _same(spark, wh)
    _log(spark, wh, "b2", _batch(spark, wh, "b2", 60, 200))
    spark.createDataFrame([("b2", 200)], "_batch_id string, rows long").write.parquet(f"{wh}/{K.CLUSTER_BATCHES}/{K.ID}=b0")
    _same(spark, wh)
    assert K.cluster_raw(spark, wh) is not None
    _same(spark, wh)
