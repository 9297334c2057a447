"""Column access audit: who read SCHEMA.TABLE.COLUMN, when, under which role.

Access history is flattened twice (objects, then their columns) and filtered
before the join, so only matching accesses meet the query history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_access(access_history: DataFrame, query_history: DataFrame,
                  object_pattern: str, column: str) -> DataFrame:
    objects = access_history.select(
        "query_id", "query_start_time", "user_name",
        F.explode("base_objects_accessed").alias("f"))
    objects = objects.where(F.col("f.objectName").ilike(object_pattern))
    cols = objects.select("query_id", "query_start_time", "user_name",
                          F.col("f.objectName").alias("table_fqn"),
                          F.explode("f.columns").alias("c"))
    hits = cols.where(F.col("c.columnName") == column).drop("c")
    roles = query_history.select("query_id", "role_name")
    return (hits.join(roles, "query_id")
            .select("query_start_time", "user_name", "role_name", "table_fqn")
            .orderBy(F.col("query_start_time").desc()))
