"""Staging, incremental build and mart goldens."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.dedup import latest_by_key, latest_by_key_window
from lakeloom.plans import marts as M
from lakeloom.plans import staging as STG

ACC_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType()), T.StructField("account_name", T.StringType()),
    T.StructField("industry", T.StringType()), T.StructField("arr", T.DecimalType(18, 2)),
    T.StructField("billing_state", T.StringType()), T.StructField("customer_tier", T.StringType()),
    T.StructField("created_date", T.TimestampNTZType()), T.StructField("_fivetran_synced", T.TimestampNTZType()),
])
OPP_SCHEMA = T.StructType([
    T.StructField("opportunity_id", T.StringType()), T.StructField("account_id", T.StringType()),
    T.StructField("owner_id", T.StringType()), T.StructField("stage_name", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("close_date", T.DateType()),
    T.StructField("created_date", T.TimestampNTZType()), T.StructField("last_modified_date", T.TimestampNTZType()),
    T.StructField("is_deleted", T.BooleanType()), T.StructField("_fivetran_synced", T.TimestampNTZType()),
])
SYNC = datetime(2026, 7, 10)

ACCOUNTS = [
    (f"a{n}", name, field, Decimal(arr), state, tier, datetime(2023, n, 2 * n, n), SYNC)
    for n, (name, field, arr, state, tier) in enumerate([
        ("Harbour Foods", "Retail", "910.50", "OR", "Gold"), ("Quill Press", "Media", "77.25", "VT", "Silver"),
        ("Tarn Outdoor", "Retail", "3000.00", "UT", "Gold")], 1)]
OPPS = [
    (f"o{n}", account, f"rep{n % 2}", stage, Decimal(amount), close, created, created, gone, SYNC)
    for n, (account, stage, amount, close, created, gone) in enumerate([
        ("a1", "Qualification", "200.00", date(2026, 3, 1), datetime(2026, 2, 1, 8), False),
        ("a2", " CLOSED   won", "40.00", date(2026, 1, 31), datetime(2026, 1, 1, 8), False),
        ("a2", "closed LOST ", "9.99", date(2025, 12, 25), datetime(2025, 12, 24, 8), False),
        ("a3", "Negotiation", "1000.00", date(2026, 2, 11), datetime(2026, 2, 1, 8), False),
        ("a3", "Prospecting", "5.00", date(2026, 9, 9), datetime(2026, 2, 1, 8), True)], 1)]


def test_mart_golden(spark):
    acc = STG.stg_accounts(spark.createDataFrame(ACCOUNTS, ACC_SCHEMA))
    opp = STG.stg_opportunities(spark.createDataFrame(OPPS, OPP_SCHEMA))
    mart = {r.opportunity_id: r for r in M.mart_opportunities(opp, acc).collect()}
    assert {k: v.days_to_close for k, v in mart.items()} == {"o1": 28, "o2": 30, "o3": 1, "o4": 10}
    assert [mart[k].stage_name for k in ("o2", "o3")] == ["Closed Won", "Closed Lost"]
    assert mart["o4"].pipeline_stage_bucket == "late"
    assert [mart[k].weighted_amount for k in ("o1", "o2", "o3", "o4")] == [
        Decimal("50.00"), Decimal("40.00"), Decimal("0.00"), Decimal("600.00")]
    assert mart["o1"].account_name == "Harbour Foods"


def test_versions_that_tie_are_chosen_by_content(spark):
    ties = [ACCOUNTS[0][:3] + (Decimal(n),) + ACCOUNTS[0][4:] for n in range(6)]
    picks = {STG.stg_accounts(spark.createDataFrame(rows, ACC_SCHEMA).repartition(k)).first().arr
             for rows in (ties, ties[::-1]) for k in (1, 3)}
    assert len(picks) == 1


def test_a_batch_that_commits_late_is_not_lost(spark, tmp_root):
    rows = lambda *ids: spark.createDataFrame([(f"e{i}", i, f"b{i}") for i in ids], "event_id string, n int, _batch_id string")
    first = STG.build_incremental(spark, f"{tmp_root}/snap", rows(2), ["event_id"], ["n"])
    assert first.count() == 1
    second = STG.build_incremental(spark, f"{tmp_root}/snap", rows(1, 2), ["event_id"], ["n"])  # b1 began before b2
    assert sorted(r.event_id for r in second.collect()) == ["e1", "e2"]


def test_cdc_versions_ties_orphans_nulls(spark):
    later = datetime(2026, 7, 11)
    rows = OPPS + [
        # a newer version wins; an older modification of the same sync loses
        ("o1", "a1", "rep1", "Negotiation", Decimal("210.00"), None, datetime(2026, 2, 1, 8), datetime(2026, 7, 10), False, later),
        ("o2", "a2", "rep0", "Prospecting", Decimal("1.00"), date(2026, 5, 31), datetime(2026, 1, 1, 8), datetime(2025, 1, 1), False, SYNC),
        # an orphan account with a NULL amount; a deleted row that a newer version brings back
        ("o9", "nobody", "rep9", "qualification", None, date(2026, 1, 1), datetime(2026, 1, 5), datetime(2026, 1, 5), False, SYNC),
        ("o5", "a3", "rep1", "Prospecting", Decimal("6.00"), date(2026, 9, 9), datetime(2026, 2, 1, 8), datetime(2026, 7, 9), False, later)]
    opp = STG.stg_opportunities(spark.createDataFrame(rows, OPP_SCHEMA))
    acc = STG.stg_accounts(spark.createDataFrame(ACCOUNTS, ACC_SCHEMA))
    mart = {r.opportunity_id: r for r in M.mart_opportunities(opp, acc).collect()}
    assert mart["o1"].stage_name == "Negotiation" and mart["o1"].days_to_close is None
    assert mart["o2"].stage_name == "Closed Won"
    assert mart["o9"].account_name is None and mart["o9"].weighted_amount is None
    assert mart["o5"].amount == Decimal("6.00")


def test_latest_by_key_is_order_independent(spark):
    rows = [(k, i, f"v{k}{i}") for k in range(5) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    a = sorted(latest_by_key(df, ["k"], ["o"]).collect())
    b = sorted(latest_by_key(df.orderBy(F.rand(3)).repartition(3), ["k"], ["o"]).collect())
    c = sorted(latest_by_key_window(df, ["k"], ["o"]).select("k", "o", "v").collect())
    assert a == b == c
    assert [r.v for r in a] == [f"v{k}6" for k in range(5)]


def test_hot_key_dedup_keeps_whole_result(spark):
    hot = spark.range(200000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    cold = spark.range(1000).select((F.col("id") + 2).alias("k"), F.col("id").alias("o"))
    out = latest_by_key(hot.unionByName(cold), ["k"], ["o"])
    assert out.count() == 1001
    assert out.where("k = 1").first().o == 199999


def test_incremental_equals_full_refresh(spark, tmp_root):
    base = [("e1", 1, "b001"), ("e2", 1, "b001"), ("e1", 2, "b002")]
    more = base + [("e2", 5, "b003"), ("e3", 1, "b003"), ("e1", 0, "b003")]
    schema = "event_id string, o int, _batch_id string"
    snap = f"{tmp_root}/snap"
    STG.build_incremental(spark, snap, spark.createDataFrame(base, schema), ["event_id"], ["_batch_id", "o"])
    inc = STG.build_incremental(spark, snap, spark.createDataFrame(more, schema), ["event_id"], ["_batch_id", "o"])
    full = STG.build_incremental(spark, f"{tmp_root}/snap2", spark.createDataFrame(more, schema),
                                 ["event_id"], ["_batch_id", "o"], full_refresh=True)
    assert sorted(inc.collect()) == sorted(full.collect())
    assert STG.current_snapshot(spark, snap).count() == 3


def test_metrics_and_seed_summary(spark):
    acc = STG.stg_accounts(spark.createDataFrame(ACCOUNTS, ACC_SCHEMA))
    opp = STG.stg_opportunities(spark.createDataFrame(OPPS, OPP_SCHEMA))
    mart = M.mart_opportunities(opp, acc)
    m = {r.pipeline_stage_bucket: r for r in M.pipeline_metrics(mart, by=("pipeline_stage_bucket",)).collect()}
    assert m["early"].opportunities == 1 and m["early"].total_amount == Decimal("200.00")
    assert m["early"].weighted_pipeline == Decimal("50.00")
    assert M.seed_summary(acc, "DB.S.ACCOUNT").first().result == "seeded 3 accounts into DB.S.ACCOUNT"


def test_clean_string(spark):
    from lakeloom.functions.text import clean_string
    df = spark.createDataFrame([("  closed\t won ",), ("NEGOTIATION",), ("   ",), (None,)], "s string")
    assert [r.c for r in df.select(clean_string(F.col("s")).alias("c")).collect()] == [
        "Closed Won", "Negotiation", None, None]


def test_null_keys_group_like_partition_by(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3)], "k string, o int")
    out = sorted(latest_by_key(df, ["k"], ["o"]).collect(), key=lambda r: (r.k or "", r.o))
    win = sorted(latest_by_key_window(df, ["k"], ["o"]).collect(), key=lambda r: (r.k or "", r.o))
    assert [(r.k, r.o) for r in out] == [(r.k, r.o) for r in win] == [(None, 2), ("a", 3)]


def test_a_late_older_version_does_not_revive_a_deleted_row(spark, tmp_root):
    deleted = OPPS[4]  # o5 is deleted
    older = deleted[:7] + (datetime(2026, 1, 1), False, datetime(2026, 7, 1))
    slices = spark.createDataFrame([(*r, "s1") for r in OPPS] + [(*older, "s2")], T.StructType([*OPP_SCHEMA.fields, T.StructField("slice", T.StringType())]))
    first = STG.stg_opportunities_incremental(spark, f"{tmp_root}/snap", slices.where("slice = 's1'"), "slice")
    second = STG.stg_opportunities_incremental(spark, f"{tmp_root}/snap", slices, "slice")
    assert sorted(r.opportunity_id for r in first.collect()) == sorted(r.opportunity_id for r in second.collect()) == ["o1", "o2", "o3", "o4"]


def test_versions_are_reduced_per_task_without_a_sorted_aggregate(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, None, "w")], "k string, o int, v string")
    out = latest_by_key(df, ["k"], ["o"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("WindowGroupLimit") == 2  # before and behind the shuffle
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 2, "y"), (None, 3, "z")]
