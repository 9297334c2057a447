"""Governance as table jobs: role closure, grant expansion, entitlements,
column classification, masked reads and row access.

Config tables are small; the role graph is resolved with a recursive CTE and
only per-request decisions (a role's closure, the tags of one table) are
brought to the driver to build a single projection, which Catalyst folds.
Masking is a read-time projection, not a security boundary: whoever can read
the files sees real values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.session import work_root
from lakeloom.sources.settings import Governance

# ---------------------------------------------------------------- role graph

def role_edges(gov: Governance) -> DataFrame:
    """(holder, member, source): holder has every privilege of member."""
    roles = gov.active("functional_roles")
    inherits = roles.select(F.col("name").alias("holder"),
                            F.explode("inherits_from").alias("member"),
                            F.lit("inherits_from").alias("source"))
    granted = roles.where(F.col("granted_to") != "").select(
        F.col("granted_to").alias("holder"), F.col("name").alias("member"),
        F.lit("granted_to").alias("source"))
    devs = gov.active("environments").select(F.explode("developers").alias("dev")).distinct()
    revops_composite = devs.select(F.concat(F.lit("DEV_"), "dev").alias("holder"),
                                   F.lit("REVOPS_READER").alias("member"),
                                   F.lit("composite").alias("source"))
    domain_composite = gov.active("sandboxes").select(
        F.concat_ws("_", F.lit("DEV"), "domain", "developer").alias("holder"),
        F.col("reader_role").alias("member"), F.lit("composite").alias("source"))
    return (inherits.unionByName(granted).unionByName(revops_composite)
            .unionByName(domain_composite).distinct())


def role_closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(role, member): every role reachable from ``role``, itself included.

    Paths double in length each step until nothing is added, so a chain of n roles
    takes about log2(n) steps and a cycle ends like any other graph."""
    work_root(spark)  # names the checkpoint folder where the session has none
    edges = edges.select("holder", "member").distinct().checkpoint()
    nodes = edges.select("holder").union(edges.select("member")).distinct()
    reach = nodes.select(F.col("holder").alias("role"), F.col("holder").alias("member")).union(edges).distinct().checkpoint()
    while True:
        onward = reach.select(F.col("role").alias("member"), F.col("member").alias("end"))
        longer = reach.join(onward, "member").select("role", F.col("end").alias("member")).distinct().checkpoint()
        if longer.count() == reach.count():
            return reach
        reach = longer


def closure_map(spark: SparkSession, gov: Governance) -> dict[str, set[str]]:
    """role -> roles in its closure, resolved once per config (config-sized)."""
    cached = gov.__dict__.get("_closure")
    if cached is None:
        cached = {}
        for r in role_closure(spark, role_edges(gov)).collect():
            cached.setdefault(r.role, set()).add(r.member)
        gov.__dict__["_closure"] = cached
    return cached


def roles_of(spark: SparkSession, gov: Governance, role: str) -> set[str]:
    """Roles in session when ``role`` is active (its closure)."""
    return closure_map(spark, gov).get(role.upper(), set()) | {role.upper()}


# ---------------------------------------------------------- grants / schemas

def active_envs(gov: Governance) -> list[str]:
    """Active environment names (config-sized list)."""
    return sorted(r.env for r in gov.active("environments").select("env").collect())


def data_schemas(gov: Governance) -> DataFrame:
    """(env, schema): DATA-kind schemas per active env plus generated sandboxes
    (``REVOPS_DEV_<DEV>`` per env developer, ``<DOMAIN>_DEV_<DEV>`` per sandbox row)."""
    envs = gov.active("environments")
    env_list = F.array(*[F.lit(e) for e in active_envs(gov)]) if active_envs(gov) else F.array().cast("array<string>")
    configured = gov.active("schemas").where(F.col("kind") == "DATA").select(
        F.explode(env_list).alias("env"), "schema")
    revops = envs.select("env", F.explode("developers").alias("dev")).select(
        "env", F.concat(F.lit("REVOPS_DEV_"), "dev").alias("schema"))
    domain = gov.active("sandboxes").join(envs.select("env"), "env", "left_semi").select(
        "env", F.concat_ws("_", "domain", F.lit("DEV"), "developer").alias("schema"))
    return configured.unionByName(revops).unionByName(domain).distinct()


def _match_keys(schema: F.Column) -> F.Column:
    """Keys a schema answers to: ``*``, ``=NAME`` and ``^P`` for every prefix P."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length(schema)),
                           lambda n: F.concat(F.lit("^"), F.substring(schema, 1, n)))
    return F.array_union(F.array(F.lit("*"), F.concat(F.lit("="), schema)), prefixes)


def _grant_key(grant_schema: F.Column) -> F.Column:
    return (F.when(grant_schema == "*", F.lit("*"))
            .when(grant_schema.endswith("*"),
                  F.concat(F.lit("^"), F.expr("substring(g_schema, 1, length(g_schema) - 1)")))
            .otherwise(F.concat(F.lit("="), grant_schema)))


def expand_grants(gov: Governance) -> DataFrame:
    """(grant_key, role, env, schema, level): wildcard grants (env ``ALL``,
    schema ``*`` / ``PREFIX*`` / exact) expanded against every active env's
    data schemas, as an equi-join on (env, match key)."""
    envs = active_envs(gov)
    env_list = F.array(*[F.lit(e) for e in envs]) if envs else F.array().cast("array<string>")
    g = gov.active("functional_grants").select(
        F.col("key").alias("grant_key"), "role", F.col("env").alias("g_env"),
        F.col("schema").alias("g_schema"), "level")
    g = g.select("grant_key", "role", "level", "g_schema",
                 F.explode(F.when(F.col("g_env") == "ALL", env_list).otherwise(F.array("g_env"))).alias("env"),
                 _grant_key(F.col("g_schema")).alias("match_key"))
    s = data_schemas(gov).select("env", "schema", F.explode(_match_keys(F.col("schema"))).alias("match_key"))
    return g.join(s, ["env", "match_key"]).select("grant_key", "role", "env", "schema", "level")


def access_role(env: Column, schema: Column, level: Column) -> Column:
    return F.concat_ws("_", F.lit("AR"), env, schema, level)


def entitlements(spark: SparkSession, gov: Governance) -> DataFrame:
    """(role, env, schema, level) each role holds, directly or inherited,
    including each composite developer role's own sandbox write."""
    grants = expand_grants(gov).select("role", "env", "schema", "level")
    envs = gov.active("environments")
    own_revops = envs.select("env", F.explode("developers").alias("dev")).where(F.col("env") == "DEV").select(
        F.concat(F.lit("DEV_"), "dev").alias("role"), "env",
        F.concat(F.lit("REVOPS_DEV_"), "dev").alias("schema"), F.lit("W").alias("level"))
    own_domain = gov.active("sandboxes").select(
        F.concat_ws("_", F.lit("DEV"), "domain", "developer").alias("role"), "env",
        F.concat_ws("_", "domain", F.lit("DEV"), "developer").alias("schema"), F.lit("W").alias("level"))
    direct = grants.unionByName(own_revops).unionByName(own_domain)
    closure = role_closure(spark, role_edges(gov))
    inherited = closure.join(direct.withColumnRenamed("role", "member"), "member").select(
        "role", "env", "schema", "level")
    return direct.unionByName(inherited).distinct()


# ----------------------------------------------------------------- masking

def tag_allowed_values(gov: Governance) -> DataFrame:
    """(tag, allowed_values): distinct union over the tag's active rules."""
    return gov.active("masking_rules").groupBy("tag").agg(
        F.array_distinct(F.flatten(F.collect_list("allowed_values"))).alias("allowed_values"))


def exempt_roles(gov: Governance) -> DataFrame:
    """(tag, roles): sorted exempt roles per tag that has an active rule."""
    tags = gov.active("masking_rules").select("tag").distinct()
    ex = gov.active("masking_exemptions").groupBy("tag").agg(F.sort_array(F.collect_list("role")).alias("roles"))
    return tags.join(ex, "tag", "left").select(
        "tag", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def base_type(data_type: str) -> str:
    return data_type.split("(")[0].strip().upper()


_WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
_REAL = (T.DoubleType, T.FloatType)
_FAMILIES = (
    (("NUMBER", "NUMERIC", "DECIMAL", "DEC"), (T.DecimalType, *_WHOLE, *_REAL)),
    (("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "BYTEINT"), (*_WHOLE, T.DecimalType)),
    (("FLOAT", "FLOAT4", "FLOAT8", "DOUBLE", "DOUBLE PRECISION", "REAL"), (*_REAL, T.DecimalType)),
    (("VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT", "NCHAR", "NVARCHAR"), (T.StringType, T.VarcharType, T.CharType)),
    (("DATE",), (T.DateType,)),
    (("DATETIME", "TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ"), (T.TimestampNTZType, T.TimestampType)),
    (("BOOLEAN", "BOOL"), (T.BooleanType,)),
    (("BINARY", "VARBINARY"), (T.BinaryType,)),
    (("VARIANT", "OBJECT", "ARRAY"), (T.VariantType, T.StructType, T.MapType, T.ArrayType)),
)
_TYPE_FAMILY = {name: types for names, types in _FAMILIES for name in names}


class MaskingError(ValueError):
    """A tagged column can't be masked as configured; nothing is shown."""


def _type_matches(data_type: str, spark_type: T.DataType) -> bool:
    if (family := _TYPE_FAMILY.get(base_type(data_type))) is None:
        raise MaskingError(f"masking rule with the unknown type {data_type}")
    return isinstance(spark_type, family)


def _rule_for(rules: list, tag: str, field: T.StructField):
    """The tag's rule for the column's type, the first by key if several fit; None if
    the tag has no active rule."""
    own = [r for r in rules if r.tag == tag]
    fit = [r for r in own if _type_matches(r.data_type, field.dataType)]
    if own and not fit:
        raise MaskingError(f"no rule of tag {tag} fits column {field.name} of type {field.dataType.simpleString()}")
    return fit[0] if fit else None


def mask_column(expression: str, column: str, spark_type: T.DataType) -> Column:
    """Rule template over ``VAL`` -> column expression of the same type."""
    if expression.strip().upper() == "NULL":
        return F.lit(None).cast(spark_type)
    sql = re.sub(r"\bVAL\b", f"`{column}`", expression)
    return F.expr(sql).cast(spark_type)


def classify(df: DataFrame, table_fqn: str | None, gov: Governance,
             column_tags: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Attach ``tag``/``tag_value`` metadata to the classified columns of a table."""
    tags = table_tags(gov, table_fqn) if table_fqn else {}
    tags.update({k.upper(): v for k, v in (column_tags or {}).items()})
    cols = []
    for f in df.schema.fields:
        t = tags.get(f.name.upper())
        if t:
            cols.append(F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, "tag": t[0], "tag_value": t[1]}))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _policies(gov: Governance):
    """Active rules and exempt roles per tag (config-sized), cached on ``gov``."""
    cached = gov.__dict__.get("_policies")
    if cached is None:
        rules = gov.active("masking_rules").orderBy("key").select("tag", "data_type", "mask_expression").collect()
        exempt = {r.tag: set(r.roles) for r in exempt_roles(gov).collect()}
        cached = gov.__dict__["_policies"] = (rules, exempt)
    return cached


def table_tags(gov: Governance, table_fqn: str) -> dict[str, tuple[str, str]]:
    """COLUMN -> (tag, tag_value) for one ``SCHEMA.TABLE`` (config rows only)."""
    classified = gov.__dict__.get("_classified")
    if classified is None:
        classified = {}
        for r in gov.active("pii_columns").select("schema", "table", "column", "tag", "tag_value").collect():
            classified.setdefault((r.schema, r.table), {})[r.column] = (r.tag, r.tag_value)
        gov.__dict__["_classified"] = classified
    parts = table_fqn.upper().split(".")
    return dict(classified.get((parts[-2], parts[-1]), {}))


def masked(spark: SparkSession, df: DataFrame, table_fqn: str | None, role: str, gov: Governance,
           column_tags: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Read ``df`` as ``role``: a tagged column whose tag has an active rule shows the
    real value when any exempt role of the tag is in the role's closure, else the
    mask of the rule for its type. Active rules none of which fits raise. One
    projection, no UDF."""
    tags = table_tags(gov, table_fqn) if table_fqn else {}
    tags.update({k.upper(): v for k, v in (column_tags or {}).items()})
    for f in df.schema.fields:  # tags carried as column metadata
        if "tag" in f.metadata and f.name.upper() not in tags:
            tags[f.name.upper()] = (f.metadata["tag"], f.metadata.get("tag_value"))
    if not tags:
        return df
    in_session = roles_of(spark, gov, role)
    rules, exempt = _policies(gov)
    cols = []
    for f in df.schema.fields:
        t = tags.get(f.name.upper())
        rule = _rule_for(rules, t[0], f) if t else None
        if rule is None or exempt.get(rule.tag, set()) & in_session:
            cols.append(F.col(f"`{f.name}`"))
        else:
            cols.append(mask_column(rule.mask_expression, f.name, f.dataType).alias(f.name, metadata=f.metadata))
    return df.select(*cols)


def tag_value_violations(gov: Governance) -> DataFrame:
    """Classified columns whose tag value is not allowed for the tag (case-sensitive)."""
    allowed = tag_allowed_values(gov).select("tag", F.explode("allowed_values").alias("tag_value"))
    return gov.active("pii_columns").join(allowed, ["tag", "tag_value"], "left_anti")


def apply_report(gov: Governance, existing: DataFrame, already_tagged: DataFrame | None = None) -> DataFrame:
    """Tolerant re-apply of classifications: ``existing`` lists (schema, table,
    column) present in the target. Missing table -> skipped; already tagged
    -> skipped; unknown tag -> failed; else applied."""
    pii = gov.active("pii_columns")
    known = gov.active("masking_rules").select("tag").distinct().withColumn("_known", F.lit(True))
    ex = existing.select(F.upper("schema").alias("schema"), F.upper("table").alias("table"),
                         F.upper("column").alias("column")).distinct().withColumn("_exists", F.lit(True))
    r = pii.join(ex, ["schema", "table", "column"], "left").join(known, "tag", "left")
    if already_tagged is not None:
        done = already_tagged.select(F.upper("schema").alias("schema"), F.upper("table").alias("table"),
                                     F.upper("column").alias("column")).distinct().withColumn("_done", F.lit(True))
        r = r.join(done, ["schema", "table", "column"], "left")
    else:
        r = r.withColumn("_done", F.lit(None).cast("boolean"))
    status = (F.when(F.col("_exists").isNull(), "skipped").when(F.col("_known").isNull(), "failed")
              .when(F.col("_done"), "skipped").otherwise("applied"))
    detail = (F.when(F.col("_exists").isNull(), "object not present").when(F.col("_known").isNull(), "unknown tag")
              .when(F.col("_done"), "already applied"))
    return r.select("key", "schema", "table", "column", "tag", "tag_value",
                    status.alias("status"), detail.alias("detail"))


# -------------------------------------------------------------- row access

def allowed_regions(spark: SparkSession, gov: Governance, role: str) -> list[str]:
    in_session = roles_of(spark, gov, role)
    rows = gov.active("row_access").where(F.col("role").isin(sorted(in_session))).select("region").distinct().collect()
    return sorted(r.region for r in rows)


def row_filter(spark: SparkSession, df: DataFrame, region: Column, role: str, gov: Governance) -> DataFrame:
    """Rows whose region is entitled to the role or any role it inherits.
    The allowed set is config-sized, so it becomes a literal IN list that
    Spark pushes into the scan."""
    return df.where(region.isin(allowed_regions(spark, gov, role)))
