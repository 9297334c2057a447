"""Masking in plain SQL: a session variable names the active role, temporary SQL
functions decide and mask, and a view applies them.

    register_governance(spark, gov)
    governed_view(spark, gov, "accounts", df, "SALESFORCE_RAW_FIVETRAN.ACCOUNT")
    spark.sql("SET VAR active_role = 'REVOPS_READER'")
    spark.sql("SELECT * FROM accounts")          -- masked for that role

Roles, closures and rules are config rows, written into the functions as literals, so
a query has no join for them and the optimizer folds the decision: a masked column
isn't read at all. The role is that of the moment a query is analyzed. An unknown,
empty or null role has no exemption. Like ``masked``, this is a projection over data
that the session can read, not a security boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeloom.operators import governance as G
from lakeloom.sources.settings import Governance

ROLE_VARIABLE = "active_role"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(value: str) -> str:
    return "`" + value.replace("`", "``") + "`"


def register_governance(spark: SparkSession, gov: Governance) -> None:
    """Declare the role variable (no role) and ``is_role_in_session(role)``: whether a
    role lies in the closure of the active one."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {ROLE_VARIABLE} STRING DEFAULT ''")
    closures = ", ".join(f"{_text(role)}, array({', '.join(map(_text, sorted(members | {role})))})"
                         for role, members in sorted(G.closure_map(spark, gov).items()))
    # A role that no edge names has itself only.
    held = f"coalesce(try_element_at(map({closures}), upper({ROLE_VARIABLE})), array(upper({ROLE_VARIABLE})))"
    if not closures:
        held = f"array(upper({ROLE_VARIABLE}))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_role_in_session(wanted STRING) RETURNS BOOLEAN "
              f"RETURN coalesce(wanted <> '' AND array_contains({held}, upper(wanted)), false)")


def _mask_function(spark: SparkSession, rule, roles: set[str], field: T.StructField) -> str:
    """The temporary function that masks one rule's tag in columns of one type."""
    kind = field.dataType.simpleString()
    name = _name(f"mask_{rule.tag}_{kind}".lower())
    shown = " OR ".join(f"is_role_in_session({_text(r)})" for r in sorted(roles)) or "false"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(VAL {kind}) RETURNS {kind} "
              f"RETURN CASE WHEN {shown} THEN VAL ELSE CAST({rule.mask_expression} AS {kind}) END")
    return name


def governed_view(spark: SparkSession, gov: Governance, view: str, df: DataFrame, table_fqn: str | None = None,
                  column_tags: dict[str, tuple[str, str]] | None = None) -> None:
    """Create the temporary view ``view`` over ``df``, masked by the active role at
    each query. Classified columns come from the table's config rows, from
    ``column_tags`` and from column metadata, as for ``masked``; a tagged column that
    no active rule of its tag fits raises. ``register_governance`` comes first."""
    tags = G.table_tags(gov, table_fqn) if table_fqn else {}
    tags.update({k.upper(): v for k, v in (column_tags or {}).items()})
    rules, exempt = G._policies(gov)
    columns = []
    for field in df.schema.fields:
        tag = tags.get(field.name.upper(), (field.metadata.get("tag"),))[0]
        rule = G._rule_for(rules, tag, field) if tag else None
        column = _name(field.name)
        if rule is not None:
            column = f"{_mask_function(spark, rule, exempt.get(rule.tag, set()), field)}({column}) AS {column}"
        columns.append(column)
    rows = f"{view}__rows"
    df.createOrReplaceTempView(rows)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {_name(view)} AS SELECT {', '.join(columns)} FROM {_name(rows)}")


def set_role(spark: SparkSession, role: str | None) -> None:
    spark.sql(f"SET VAR {ROLE_VARIABLE} = {'NULL' if role is None else _text(role)}")
