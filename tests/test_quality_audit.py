from datetime import datetime

import pytest

from lakeloom.operators import quality as Q
from lakeloom.operators.audit import column_access


def test_checks_summary_and_gate(spark):
    child = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (2, "zz", "y"), (None, "b", "q")],
                                  "id int, stage string, parent string")
    parent = spark.createDataFrame([("x",), ("y",)], "pid string")
    checks = [
        Q.not_null("c", "id"),
        Q.unique("c", "id"),
        Q.accepted_values("c", "stage", ["a", "b"]),
        Q.relationships("c", "parent", "p", "pid", severity="warn"),
        Q.expression("id_positive", "c", "id <= 0"),
    ]
    out = {r.check_name: (r.failures, r.status) for r in Q.run_checks({"c": child, "p": parent}, checks).collect()}
    assert out["not_null_c_id"] == (1, "fail")
    assert out["unique_c_id"] == (1, "fail")
    assert out["accepted_values_c_stage"] == (1, "fail")
    assert out["relationships_c_parent__p_pid"] == (1, "warn")
    assert out["id_positive"] == (0, "pass")
    with pytest.raises(Q.QualityError):
        Q.assert_checks(Q.run_checks({"c": child, "p": parent}, checks))


def test_column_access_audit(spark):
    ah = spark.createDataFrame([
        ("q1", datetime(2026, 1, 1, 10), "ANA", [("DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT", [("ARR",), ("NAME",)])]),
        ("q2", datetime(2026, 1, 2, 10), "BEN", [("db.salesforce_raw_fivetran.account", [("NAME",)])]),
        ("q3", datetime(2026, 1, 3, 10), "CY", [("DB.MARTS.X", [("ARR",)]),
                                               ("DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT", [("ARR",)])]),
    ], "query_id string, query_start_time timestamp_ntz, user_name string, "
       "base_objects_accessed array<struct<objectName:string, columns:array<struct<columnName:string>>>>")
    qh = spark.createDataFrame([("q1", "REVOPS_ADMIN"), ("q2", "REVOPS_READER"), ("q3", "REVOPS_ANALYST")],
                               "query_id string, role_name string")
    rows = column_access(ah, qh, "%SALESFORCE_RAW_FIVETRAN.ACCOUNT", "ARR").collect()
    assert [(r.user_name, r.role_name) for r in rows] == [("CY", "REVOPS_ANALYST"), ("ANA", "REVOPS_ADMIN")]


def test_further_kinds_and_unknown_ones(spark):
    import pytest

    from lakeloom.operators import quality as Q

    child = spark.createDataFrame([(1, "A1", "p", True), (1, "bad", None, False), (2, None, "q", False), (2, "B2", "gone", True), (3, "C3", None, True)],
                                  "g int, code string, parent string, main boolean")
    parent = spark.createDataFrame([("p",), ("q",)], "id string")
    checks = [Q.empty("no_rows", "child"), Q.pattern("child", "code", "^[A-Z][0-9]$"), Q.one_per_group("child", "g", "main"),
              Q.conditional_reference("child", "parent", "parent", "id", "main")]
    got = {r.check_name: r.failures for r in Q.run_checks({"child": child, "parent": parent}, checks).collect()}
    assert got == {"no_rows": 5, "pattern_child_code": 1, "one_per_group_child_g": 0, "conditional_reference_child_parent": 2}
    with pytest.raises(ValueError, match="unknown check kinds"):
        Q.run_checks({"child": child}, [Q.Check("c", "child", "frequency")])
