"""Change-captured replica tables (schema-on-write, the source may ALTER).

Read only the columns the models depend on, with the registered types, and
report drift against the contract: additive columns are surfaced, breaking
changes (missing column, changed type) are flagged and block the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCOUNT_TABLE = "SALESFORCE_RAW_FIVETRAN.ACCOUNT"
OPPORTUNITY_TABLE = "SALESFORCE_RAW_FIVETRAN.OPPORTUNITY"
ACCOUNT_CONTRACT = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("arr", T.DecimalType(18, 2)),
    T.StructField("billing_state", T.StringType()),
    T.StructField("customer_tier", T.StringType()),
    T.StructField("created_date", T.TimestampNTZType()),
    T.StructField("_fivetran_synced", T.TimestampNTZType()),
])

OPPORTUNITY_CONTRACT = T.StructType([
    T.StructField("opportunity_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("owner_id", T.StringType()),
    T.StructField("stage_name", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("close_date", T.DateType()),
    T.StructField("created_date", T.TimestampNTZType()),
    T.StructField("last_modified_date", T.TimestampNTZType()),
    T.StructField("is_deleted", T.BooleanType()),
    T.StructField("_fivetran_synced", T.TimestampNTZType()),
])


class ContractError(RuntimeError):
    pass


def contract_report(spark: SparkSession, df: DataFrame, contract: T.StructType) -> DataFrame:
    """(column, expected_type, actual_type, status) with status ok / missing /
    type_changed (breaking) or added (additive). Schema metadata only."""
    actual = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    expected = {f.name.lower(): f.dataType.simpleString() for f in contract.fields}
    rows = []
    for name, typ in expected.items():
        got = actual.get(name)
        status = "missing" if got is None else ("ok" if got == typ else "type_changed")
        rows.append((name, typ, got, status))
    rows += [(name, None, typ, "added") for name, typ in actual.items() if name not in expected]
    return spark.createDataFrame(rows, "column string, expected_type string, actual_type string, status string")


def conform(df: DataFrame, contract: T.StructType, *, strict: bool = True) -> DataFrame:
    """Select the contract columns with their types; raise on breaking drift."""
    actual = {f.name.lower(): f for f in df.schema.fields}
    broken = [f.name for f in contract.fields
              if f.name.lower() not in actual or
              (strict and actual[f.name.lower()].dataType != f.dataType)]
    if broken:
        raise ContractError(f"breaking source drift in column(s): {', '.join(broken)}")
    return df.select(*[F.col(f"`{actual[f.name.lower()].name}`").cast(f.dataType).alias(f.name)
                       for f in contract.fields])


def read_cdc(spark: SparkSession, path: str, contract: T.StructType, *, strict: bool = True) -> DataFrame:
    """Typed replica read: only the contract columns reach the scan."""
    return conform(spark.read.parquet(path), contract, strict=strict)
