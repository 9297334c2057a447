"""Row checks are counted by the write itself; a failing layer stays unpublished."""

import pytest

from lakeloom.config import Target
from lakeloom.operators import quality as Q
from lakeloom.plans import build as B


def test_counts_come_from_the_write(spark, tmp_root):
    acc = spark.sparkContext.accumulator(0)

    def seen(v):
        acc.add(1)
        return v
    from pyspark.sql import functions as F
    passed = F.udf(seen, "string")
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string").repartition(1).select(passed("k").alias("k"))
    checks = [Q.not_null("m", "k"), Q.accepted_values("m", "k", ["a"]), Q.unique("m", "k")]
    _, _, written, observation = B.write_version(spark, df, f"{tmp_root}/m", checks)
    assert acc.value == 3
    rows = {r.check_type: (r.failures, r.status) for r in Q.written_summary(spark, checks, {"m": observation}, {"m": written}).collect()}
    assert rows == {"not_null": (1, "fail"), "accepted_values": (1, "fail"), "unique": (0, "pass")}
    assert acc.value == 3  # no second pass over the model


def test_an_empty_model_and_no_checks(spark, tmp_root):
    df = spark.createDataFrame([], "k string")
    checks = [Q.not_null("m", "k"), Q.empty("none", "m")]
    *_, written, observation = B.write_version(spark, df, f"{tmp_root}/m", checks)
    assert {r.status for r in Q.written_summary(spark, checks, {"m": observation}, {"m": written}).collect()} == {"pass"}
    assert Q.written_summary(spark, [], {}, {}).collect() == []


def test_a_failing_staging_check_publishes_nothing(spark, tmp_root):
    from lakeloom.plans import catalog as K
    target = Target(tmp_root)
    sf = "/root/testdata/sf0.001"
    with pytest.raises(Q.QualityError, match="accepted_values") as failed:
        B.build_sales_models(spark, K.accounts_feed(spark, sf), K.opportunities_feed(spark, sf), target,
                             [Q.accepted_values("stg_accounts", "customer_tier", ["none"])], K.governance(spark))
    assert failed.value.summary.count() == 1
    assert B.read_model(spark, target.path("staging", "stg_accounts")) is None
