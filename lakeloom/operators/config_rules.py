"""Cross-table config rules, evaluated as anti-joins and group-bys.

Each rule yields violation rows ``(rule, table, key, message)``; an empty
result means the config is consistent. Inactive rows are ignored everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.settings import Governance

VIOLATION_COLUMNS = ["rule", "table", "key", "message"]


def _v(df: DataFrame, rule: str, table: str, message) -> DataFrame:
    msg = message if not isinstance(message, str) else F.lit(message)
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"),
                     F.col("key").alias("key"), msg.alias("message"))


def _unknown(df: DataFrame, col: str, known: DataFrame, known_col: str, rule: str, table: str,
             what: str) -> DataFrame:
    ref = known.select(F.col(known_col).alias("_ref")).distinct()
    bad = df.where(F.col(col) != "").join(ref, F.col(col) == F.col("_ref"), "left_anti")
    return _v(bad, rule, table, F.concat(F.lit(f"unknown {what} '"), F.col(col), F.lit("'")))


def config_violations(gov: Governance) -> DataFrame:
    roles = gov.active("functional_roles")
    schemas = gov.active("schemas")
    envs = gov.active("environments")
    rules = gov.active("masking_rules")
    parts: list[DataFrame] = []

    # Exactly one default warehouse per function.
    wh = gov.active("warehouses").groupBy("function").agg(F.count_if("is_default").alias("defaults"))
    parts.append(_v(wh.where(F.col("defaults") != 1).withColumn("key", F.col("function")),
                    "one_default_per_function", "warehouses",
                    F.format_string("%d warehouses are marked as this function's default", "defaults")))
    # Role hierarchy references known roles.
    inherits = roles.select("key", F.explode("inherits_from").alias("parent"))
    parts.append(_unknown(inherits, "parent", roles, "name", "known_parent_role", "functional_roles", "role"))
    # Mask expressions reference VAL or are NULL.
    parts.append(_v(rules.where(~F.col("mask_expression").contains("VAL") &
                                (F.upper("mask_expression") != "NULL")),
                    "mask_references_val", "masking_rules", "the mask neither uses the masked value nor hides it"))
    # One policy per (tag, data_type).
    dup = rules.groupBy("tag", "data_type").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    parts.append(_v(dup.where(F.col("n") > 1), "unique_tag_data_type", "masking_rules",
                    F.format_string("%d rules mask %s columns tagged %s", "n", "data_type", "tag")))
    # Classified columns: known schema and tag.
    pii = gov.active("pii_columns")
    parts.append(_unknown(pii, "schema", schemas, "schema", "known_schema", "pii_columns", "schema"))
    parts.append(_unknown(pii, "tag", rules, "tag", "known_tag", "pii_columns", "tag"))
    # Exemptions: known tag and role.
    ex = gov.active("masking_exemptions")
    parts.append(_unknown(ex, "tag", rules, "tag", "known_tag", "masking_exemptions", "tag"))
    parts.append(_unknown(ex, "role", roles, "name", "known_role", "masking_exemptions", "role"))
    # Sandboxes: known reader role, active env.
    sb = gov.active("sandboxes")
    parts.append(_unknown(sb, "reader_role", roles, "name", "known_role", "sandboxes", "reader_role"))
    parts.append(_unknown(sb, "env", envs, "env", "active_env", "sandboxes", "env"))
    # Humans may only hold human-assignable roles (the allowed set depends on a flag).
    human_ok = roles.where(F.col("human_assignable"))
    parts.append(_unknown(gov.active("user_roles"), "role_name", human_ok, "name",
                          "human_assignable_role", "user_roles", "human-assignable role"))
    # Grants: known role, env ALL or active, exact schema known.
    g = gov.active("functional_grants")
    parts.append(_unknown(g, "role", roles, "name", "known_role", "functional_grants", "role"))
    parts.append(_unknown(g.where(F.col("env") != "ALL"), "env", envs, "env", "active_env",
                          "functional_grants", "env"))
    parts.append(_unknown(g.where(~F.col("schema").endswith("*")), "schema", schemas, "schema",
                          "known_schema", "functional_grants", "schema"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*VIOLATION_COLUMNS)
