
import pytest
from pyspark.sql import functions as F

from conftest import F_A, F_B
from lakeloom.config import EVENTS, Target
from lakeloom.functions.text import snake_case, snake_case_columns
from lakeloom.operators import commit as C
from lakeloom.operators import governance as G
from lakeloom.plans.build import build_sales_models, read_model
from lakeloom.plans.catalog import model_checks
from lakeloom.plans.ingest import ingest
from lakeloom.sources import standins as S
from lakeloom.sources.cdc import ACCOUNT_CONTRACT, ContractError, conform, contract_report
from lakeloom.sources.landing import ScanScope
from lakeloom.sources.settings import Governance

SF = "/root/testdata/sf0.001"


def test_contract_drift(spark):
    feed = S.account_feed(S.table(spark, SF, "customer"))
    ok = {r.status for r in contract_report(spark, feed, ACCOUNT_CONTRACT).collect()}
    assert ok == {"ok"}
    drifted = feed.withColumn("new_col", F.lit(1)).withColumn("arr", F.col("arr").cast("double")).drop("industry")
    rep = {r.column: r.status for r in contract_report(spark, drifted, ACCOUNT_CONTRACT).collect()}
    assert rep["new_col"] == "added" and rep["arr"] == "type_changed" and rep["industry"] == "missing"
    with pytest.raises(ContractError):
        conform(drifted, ACCOUNT_CONTRACT)
    # additive drift alone is fine: only contract columns are read
    assert conform(feed.withColumn("new_col", F.lit(1)), ACCOUNT_CONTRACT).columns == ACCOUNT_CONTRACT.names


def test_build_publish_and_targets(spark, tmp_root):
    acc = S.account_feed(S.table(spark, SF, "customer"))
    opp = S.opportunity_feed(S.table(spark, SF, "orders"))
    prod = Target(f"{tmp_root}/prod")
    dev = Target(f"{tmp_root}/dev", sandbox="REVOPS_DEV_ROBIN_LEE")
    summary = build_sales_models(spark, acc, opp, prod, model_checks())
    assert summary.where("status = 'fail'").count() == 0
    build_sales_models(spark, acc, opp, dev, model_checks())
    assert dev.path("marts", "mart_opportunities").endswith("REVOPS_DEV_ROBIN_LEE/marts_revops__mart_opportunities")
    a = read_model(spark, prod.path("marts", "mart_opportunities"))
    b = read_model(spark, dev.path("marts", "mart_opportunities"))
    assert a.count() == b.count() > 0
    # a rebuild replaces the current version; the old one stays until cleaned up
    build_sales_models(spark, acc, opp, prod, model_checks())
    assert read_model(spark, prod.path("marts", "mart_opportunities")).count() == a.count()


def test_dry_run_writes_nothing(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    res = ingest(spark, EVENTS["page_views"], sample_landing, wh, ScanScope.backfill(), dry_run=True)
    assert {(r.file_name, r.status) for r in res.report.collect()} == {(F_A, "would load"), (F_B, "would load")}
    assert C.committed(spark, wh, C.RAW).count() == 0


def test_range_filter_and_snake_case(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    ingest(spark, EVENTS["page_views"], sample_landing, wh, ScanScope.backfill())
    raw = C.committed(spark, wh, C.RAW)
    assert C.events_between(raw, "2026-03-14 20:06:30", "2026-03-14 21:02:30").count() == 5
    assert snake_case("StageName") == "stage_name" and snake_case("Close Date") == "close_date"
    df = spark.createDataFrame([(1,)], "`AccountId` int")
    assert snake_case_columns(df).columns == ["account_id"]


def test_hash_mask_rule(spark):
    rules = spark.createDataFrame(
        [("k", "PII_CONTACT", ["email"], "VARCHAR", "SHA2(VAL, 256)", "", True)],
        "key string, tag string, allowed_values array<string>, data_type string, "
        "mask_expression string, comment string, is_active boolean")
    gov = Governance.load(spark, masking_rules=rules)
    df = spark.createDataFrame([("a@b.c",)], "email string")
    out = G.masked(spark, df, None, "REVOPS_READER", gov, column_tags={"email": ("PII_CONTACT", "email")}).first()
    import hashlib
    assert out.email == hashlib.sha256(b"a@b.c").hexdigest()


def test_cli_build_and_masked_read(spark, tmp_root, capsys):
    from lakeloom.cli import main
    acc, opp = f"{tmp_root}/acc", f"{tmp_root}/opp"
    S.account_feed(S.table(spark, SF, "customer")).write.parquet(acc)
    S.opportunity_feed(S.table(spark, SF, "orders")).write.parquet(opp)
    assert main(["build", "--accounts", acc, "--opportunities", opp, "--target-root", f"{tmp_root}/t",
                 "--sandbox", "REVOPS_DEV_ROBIN_LEE"]) == 0
    out = capsys.readouterr().out
    assert "unique_stg_opportunities_opportunity_id failures=0" in out and "FAIL " not in out
    assert main(["masked-read", "--path", acc, "--table", "SALESFORCE_RAW_FIVETRAN.ACCOUNT",
                 "--role", "REVOPS_READER", "--limit", "3"]) == 0
    import json
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert len(rows) == 3 and all(r["arr"] is None for r in rows)
