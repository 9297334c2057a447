"""Bucketed snapshots: only met buckets are rewritten, epochs count once."""

import pytest

from lakeloom.operators import snapshot as S

SCHEMA = "id long, v string, at long, _batch_id string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def merge(spark, root, df, **kw):
    return S.merge(spark, root, df, ["id"], ["at"], "_batch_id", **kw)


def content(df):
    return sorted((r.id, r.v) for r in df.collect())


def test_untouched_buckets_keep_their_files(spark, tmp_root):
    first = rows(spark, *[(i, "old", 1, "b1") for i in range(50)])
    merge(spark, tmp_root, first, buckets=8)
    before = {(r.bucket, r.file) for r in S.files_by_bucket(spark, tmp_root).collect()}
    both = first.unionByName(rows(spark, (7, "new", 2, "b2"), (7, "late", 0, "b2")))
    out = merge(spark, tmp_root, both, buckets=99)
    assert content(out) == [(i, "new" if i == 7 else "old") for i in range(50)]
    after = {(r.bucket, r.file) for r in S.files_by_bucket(spark, tmp_root).collect()}
    met = spark.range(7, 8).select(S.bucket_of(["id"], 8)).first()[0]
    assert {b for b, _ in before ^ after} == {met} and len({b for b, _ in after}) == len({b for b, _ in before}) > 4
    assert sorted(r._batch_id for r in S.consumed(spark, tmp_root, "_batch_id").collect()) == ["b1", "b2"]
    assert spark.read.parquet(f"{tmp_root}/consumed").count() == 2  # increments, not the whole list again


def test_late_batch_full_refresh_and_null_id(spark, tmp_root):
    a, b = rows(spark, (1, "a", 5, "b2"), (2, "x", 1, "b2")), rows(spark, (1, "b", 3, "b1"), (3, "y", 1, "b1"))
    merge(spark, tmp_root, a)
    assert content(merge(spark, tmp_root, a.unionByName(b))) == [(1, "a"), (2, "x"), (3, "y")]
    n = S.commits(spark, tmp_root).count()
    assert content(merge(spark, tmp_root, a.unionByName(b))) == [(1, "a"), (2, "x"), (3, "y")]
    assert S.commits(spark, tmp_root).count() == n  # nothing new, no commit
    assert content(merge(spark, tmp_root, b, full_refresh=True)) == [(1, "b"), (3, "y")]
    assert content(merge(spark, tmp_root, a.unionByName(b))) == [(1, "a"), (2, "x"), (3, "y")]
    with pytest.raises(Exception, match="null _batch_id"):
        merge(spark, tmp_root, rows(spark, (9, "n", 1, None)))
    assert content(S.current(spark, tmp_root)) == [(1, "a"), (2, "x"), (3, "y")]


def test_empty_source_and_extra_columns_with_clashing_names(spark, tmp_root):
    assert S.current(spark, tmp_root) is None
    assert merge(spark, tmp_root, rows(spark)).collect() == []
    extra = rows(spark, (1, "a", 1, "b1")).selectExpr("*", "1 as bucket", "'q' as version")
    assert [tuple(r) for r in merge(spark, f"{tmp_root}/x", extra).collect()] == [(1, "a", 1, "b1", 1, "q")]


def test_an_epoch_counts_once(spark, tmp_root):
    a, b = rows(spark, (1, "a", 1, "b1")), rows(spark, (2, "b", 1, "b2"))
    merge(spark, tmp_root, a, stream="s", epoch=0)
    assert content(merge(spark, tmp_root, b, stream="s", epoch=0)) == [(1, "a")]
    assert content(merge(spark, tmp_root, b, stream="s", epoch=1)) == [(1, "a"), (2, "b")]
    assert content(merge(spark, tmp_root, rows(spark, (3, "c", 1, "b3")), stream="other", epoch=1)) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_merge_writes_its_own_rows_until_they_outgrow_the_bucket(spark, tmp_root):
    written = lambda: spark.read.parquet(f"{tmp_root}/data").count()
    source = rows(spark, *[(i, "old", 1, "b0") for i in range(5)])
    merge(spark, tmp_root, source, buckets=1)
    expected = {i: "old" for i in range(5)}
    for n in (1, 2):
        source = source.unionByName(rows(spark, *[(i, f"v{n}", 1 + n, f"b{n}") for i in range(n, n + 5)], (0, "late", 0, f"b{n}")))
        expected |= {i: f"v{n}" for i in range(n, n + 5)}
        assert content(merge(spark, tmp_root, source)) == sorted(expected.items())
        assert written() == (5 + 6 if n == 1 else 5 + 2 * 6 + 7)  # the bucket again only when 12 rows came to 5
    assert len(S.files_by_bucket(spark, tmp_root).collect()) == 1


def test_many_small_merges_onto_a_snapshot_of_before(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(S, "INCREMENTS", 1)
    monkeypatch.setattr(S, "NAMED_IDS", 0)
    source = rows(spark, *[(i, "old", 1, "b0") for i in range(30)])
    merge(spark, tmp_root, source, buckets=1)
    version = S.commits(spark, tmp_root).first().version
    for folder, kept in (("commits", ["version", "buckets", "full", "stream", "epoch"]), (f"touched/_version={version}", ["_bucket"])):
        old = spark.read.parquet(f"{tmp_root}/{folder}").select(kept)  # written without keys, counts and marks
        spark.createDataFrame(old.collect(), old.schema).write.mode("overwrite").parquet(f"{tmp_root}/{folder}")
    for n in (1, 2, 3):
        source = source.unionByName(rows(spark, (n, "new", 2, f"b{n}")))
        assert content(merge(spark, tmp_root, source)) == [(i, "new" if 1 <= i <= n else "old") for i in range(30)]
