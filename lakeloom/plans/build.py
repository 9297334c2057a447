"""Model build: staging -> checks -> publish -> mart -> checks -> publish.

Each published model is a versioned replace (``CREATE OR REPLACE`` on plain
Parquet): the new version is written in full, then a version row is appended;
readers take the newest version, so a failed build never shows half a table.
``Target`` relocates every model (sandbox builds write ``<layer>__<model>``).
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeloom.config import Target
from lakeloom.operators import governance as G
from lakeloom.operators import quality as Q
from lakeloom.operators.commit import is_missing_path
from lakeloom.plans import marts as M
from lakeloom.plans import staging as STG
from lakeloom.sources.cdc import ACCOUNT_TABLE, OPPORTUNITY_TABLE
from lakeloom.sources.settings import CONF_DIR, Governance


def write_version(spark: SparkSession, df: DataFrame, path: str, checks: list[Q.Check] = ()) -> tuple[int, str, DataFrame, Observation | None]:
    """Write a new, not yet current version of a model; returns it read back, and what
    the write has counted for the row checks (no further scan)."""
    df, seen = Q.observed(df, list(checks))
    version = time.time_ns() // 1000
    data = f"{path.rstrip('/')}/v_{version}_{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(data)
    return version, data, spark.read.parquet(data), seen


def make_current(spark: SparkSession, path: str, version: int, data: str) -> None:
    """Append the version row: from now on readers see this version."""
    spark.createDataFrame([(version, data)], "version long, path string") \
        .write.mode("append").parquet(f"{path.rstrip('/')}/_versions")


def publish(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write a new version of the model and make it current; returns it."""
    version, data, written, _ = write_version(spark, df, path)
    make_current(spark, path, version, data)
    return written


def read_model(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        versions = spark.read.parquet(f"{path.rstrip('/')}/_versions")
    except AnalysisException as e:
        if is_missing_path(e):
            return None
        raise
    last = versions.orderBy(F.col("version").desc()).select("path").take(1)
    return spark.read.parquet(last[0]["path"]) if last else None


def build_sales_models(spark: SparkSession, accounts_src: DataFrame, opportunities_src: DataFrame,
                       target: Target, checks: list[Q.Check], gov: Governance | None = None) -> DataFrame:
    """Build, test and publish staging and mart. Each model is computed once: it is written
    as a new version, and the same pass counts the rows that fail row checks; unique and
    relationship checks read the written data. Only a passing layer becomes current. Classified columns, and those derived from
    them, are written with their tags, so masked reads of a built model need no tags
    passed. Returns the check summary."""
    gov = gov or Governance.load(spark, CONF_DIR)
    acc_path, opp_path = target.path("staging", "stg_accounts"), target.path("staging", "stg_opportunities")
    def of(model: str) -> list[Q.Check]:
        return [c for c in checks if c.model == model]

    acc_v = write_version(spark, G.classify(STG.stg_accounts(accounts_src), ACCOUNT_TABLE, gov), acc_path, of("stg_accounts"))
    opp_v = write_version(spark, G.classify(STG.stg_opportunities(opportunities_src), OPPORTUNITY_TABLE, gov), opp_path, of("stg_opportunities"))
    staged, seen = {"stg_accounts": acc_v[2], "stg_opportunities": opp_v[2]}, {"stg_accounts": acc_v[3], "stg_opportunities": opp_v[3]}
    summary = Q.assert_checks(Q.written_summary(spark, of("stg_accounts") + of("stg_opportunities"), seen, staged))
    make_current(spark, acc_path, acc_v[0], acc_v[1])
    make_current(spark, opp_path, opp_v[0], opp_v[1])
    mart_path = target.path("marts", "mart_opportunities")
    mart = M.mart_opportunities(opp_v[2], acc_v[2])
    mart_v = write_version(spark, G.classify(mart, None, gov, M.MART_COLUMN_TAGS), mart_path, of("mart_opportunities"))
    models = {**staged, "mart_opportunities": mart_v[2]}
    summary = Q.assert_checks(Q.written_summary(spark, of("mart_opportunities"), {"mart_opportunities": mart_v[3]}, models), summary)
    make_current(spark, mart_path, mart_v[0], mart_v[1])
    return summary
