"""Config tables: header CSV files read with Spark and cleaned as columns
(trim, upper-case identifiers, booleans, pipe-separated lists).
Inactive rows are kept with ``is_active = false``; readers filter them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import pipe_list, truthy

CONF_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "conf")

# Per table: identifier columns to upper-case, boolean columns, list columns
# (upper-cased lists, then case-kept lists).
_RULES = {
    "environments": (["env"], ["is_active"], ["developers"], []),
    "schemas": (["schema", "kind"], ["writer_owns_future", "is_active"], [], []),
    "functional_roles": (["name", "granted_to", "warehouse"], ["human_assignable", "is_active"], ["inherits_from"], []),
    "functional_grants": (["role", "env", "schema", "level"], ["is_active"], [], []),
    "masking_rules": (["tag", "data_type"], ["is_active"], [], ["allowed_values"]),
    "masking_exemptions": (["tag", "role_type", "role"], ["is_active"], [], []),
    "pii_columns": (["schema", "table", "column", "tag"], ["is_active"], [], []),
    "sandboxes": (["env", "domain", "developer", "reader_role"], ["is_active"], [], []),
    "user_roles": (["username", "role_name"], ["is_active"], [], []),
    "warehouses": (["function", "size"], ["is_default", "is_active"], [], []),
    "row_access": (["role", "region"], ["is_active"], [], []),
}


def read_config(spark: SparkSession, name: str, folder: str = CONF_DIR) -> DataFrame:
    df = spark.read.option("header", "true").option("escape", '"').csv(f"{folder}/{name}.csv")
    upper, bools, lists_upper, lists_kept = _RULES[name]
    cols = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in upper:
            cols.append(F.upper(F.trim(F.coalesce(col, F.lit("")))).alias(c))
        elif c in bools:
            cols.append(truthy(col).alias(c))
        elif c in lists_upper:
            cols.append(pipe_list(col, upper=True).alias(c))
        elif c in lists_kept:
            cols.append(pipe_list(col, upper=False).alias(c))
        else:
            cols.append(F.trim(F.coalesce(col, F.lit(""))).alias(c))
    return df.select(*cols)


class Governance:
    """All governance config tables of one deployment.

    Tables are read on first use (a masked read needs four of them), and the
    per-request decisions derived from them (role closure, rules, exemptions)
    are cached on the object: load once per session, reuse for every read.
    """

    def __init__(self, spark: SparkSession, folder: str = CONF_DIR, **overrides: DataFrame):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = dict(overrides)

    @classmethod
    def load(cls, spark: SparkSession, folder: str = CONF_DIR, **overrides: DataFrame) -> "Governance":
        unknown = set(overrides) - set(_RULES)
        if unknown:
            raise ValueError(f"unknown config tables: {sorted(unknown)}")
        return cls(spark, folder, **overrides)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _RULES:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = read_config(self.spark, name, self.folder)
        return self._tables[name]

    def active(self, name: str) -> DataFrame:
        return getattr(self, name).where(F.col("is_active"))
