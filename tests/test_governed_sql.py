"""Governed views in plain SQL show what ``masked`` shows, role by role."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import governance as G
from lakeloom.operators.governed_sql import governed_view, register_governance, set_role
from lakeloom.sources.settings import Governance, read_config

ACCOUNT = "SALESFORCE_RAW_FIVETRAN.ACCOUNT"
ROLES = ["REVOPS_ADMIN", "REVOPS_READER", "FINANCE_ANALYST", "SYSADMIN", "DEV_ROBIN_LEE", "nobody's", "sysadmin", ""]


def test_view_follows_the_active_role(spark):
    gov = Governance.load(spark)
    df = spark.createDataFrame([("a", Decimal("10.00")), (None, None)], "account_id string, arr decimal(18,2)")
    register_governance(spark, gov)
    governed_view(spark, gov, "gov_accounts", df, ACCOUNT)
    assert [r.arr for r in spark.sql("SELECT arr FROM gov_accounts").collect()] == [None, None]  # no role yet
    for role in ROLES:
        set_role(spark, role)
        got = spark.sql("SELECT * FROM gov_accounts")
        want = G.masked(spark, df, ACCOUNT, role, gov)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), role
    set_role(spark, None)
    assert spark.sql("SELECT sum(arr) FROM gov_accounts").first()[0] is None
    spark.sql("SET VAR active_role = 'SYSADMIN'")
    shown = spark.sql("SELECT sum(arr) AS arr FROM gov_accounts")
    set_role(spark, "REVOPS_READER")
    assert shown.first()[0] == Decimal("10.00")  # the role when the query was analyzed
    assert spark.sql("SELECT is_role_in_session('revops_reader'), is_role_in_session('REVOPS_ADMIN'), "
                     "is_role_in_session(NULL), is_role_in_session('')").first()[:] == (True, False, False, False)


def test_masks_by_template_metadata_and_failing_closed(spark):
    gov = Governance.load(spark, masking_rules=read_config(spark, "masking_rules").withColumn("is_active", F.lit(True)))
    df = spark.createDataFrame([("jo@x.org", "+1 555 1234", 1)], "`e mail` string, phone string, n int")
    tagged = G.classify(df, None, gov, column_tags={"e mail": ("PII_CONTACT", "email")})
    register_governance(spark, gov)
    governed_view(spark, gov, "gov_contacts", tagged, column_tags={"phone": ("PII_PHONE", "phone")})
    set_role(spark, "REVOPS_READER")
    assert spark.table("gov_contacts").first()[:] == ("****@x.org", "***-***-1234", 1)
    wrong = spark.createDataFrame([(1.0,)], "email double")
    with pytest.raises(G.MaskingError):
        governed_view(spark, gov, "gov_wrong", wrong, column_tags={"email": ("PII_CONTACT", "email")})


def test_a_masked_column_is_not_read(spark, tmp_path):
    gov, path = Governance.load(spark), str(tmp_path / "accounts")
    spark.createDataFrame([("a", Decimal("10.00"))], "account_id string, arr decimal(18,2)").write.parquet(path)
    register_governance(spark, gov)
    governed_view(spark, gov, "gov_stored", spark.read.parquet(path), ACCOUNT)

    def scanned(role):
        set_role(spark, role)
        plan = spark.sql("SELECT account_id, arr FROM gov_stored WHERE account_id = 'a'")._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "Python" not in text and "PushedFilters: [IsNotNull(account_id), EqualTo(account_id,a)]" in text
        return text[text.index("ReadSchema"):]

    assert "arr" in scanned("REVOPS_ADMIN") and "arr" not in scanned("REVOPS_READER")


def test_of_two_rules_that_fit_the_first_by_key_counts(spark):
    rules = read_config(spark, "masking_rules").where("tag = 'PII_CONTACT'").withColumn("is_active", F.lit(True))
    two = rules.withColumn("key", F.lit("a_first")).withColumn("mask_expression", F.lit("'hidden'"))
    df = spark.createDataFrame([("jo@x.org",)], "email string")
    for both in (rules.unionByName(two), two.unionByName(rules)):
        gov = Governance.load(spark, masking_rules=both)
        assert G.masked(spark, df, None, "REVOPS_READER", gov, {"email": ("PII_CONTACT", "email")}).first()[0] == "hidden"
