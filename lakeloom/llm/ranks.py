"""Places and running sums inside groups of any size.

A window over a group sorts the group in one task. Here rows are dealt by range over
(group, order), so a group that holds a third of all rows is spread over a third of the
partitions; what stands before a partition's share of a group comes from a table with
one row for each group and partition that meet.

Null keys form a group of their own; nulls come first in the order. Rows equal in keys
and order follow each other in no fixed order, so callers name enough order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import stored


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "ranged") -> DataFrame:
    """``df`` written in the order of (keys, order), with ``_part`` (range) and ``_at`` (place in the whole)."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(placed.withColumn("_part", F.shiftright("_at", 33)), kind)


def _prior(parts: DataFrame, keys: Sequence[str], sums: dict[str, F.Column]) -> DataFrame:
    """For each group and range: the sums over the group's earlier ranges (``_b_<name>``)
    and over the whole group (``_all_<name>``), and the range's first place."""
    shares = parts.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), *[c.alias(f"_s_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return shares.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(group).alias(f"_all_{n}") for n in sums])


def _with_prior(parts: DataFrame, keys: Sequence[str], sums: dict[str, F.Column]) -> DataFrame:
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return parts.join(_prior(parts, keys, sums), on).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with each row's place in its group (from 0) and the group's size."""
    parts = _with_prior(ranged(df, keys, order), keys, {"n": F.count(F.lit(1))})
    return parts.withColumn(rank, F.col("_b_n") + F.col("_at") - F.col("_first")).withColumnRenamed("_all_n", size).drop("_first", "_b_n")


def suffix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_onward``: the sum over the row and all later ones of its group."""
    parts = _with_prior(ranged(df, keys, order), keys, {c: F.sum(c) for c in columns})
    here = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        parts = parts.withColumn(f"{c}_onward", F.col(f"_all_{c}") - F.col(f"_b_{c}") - F.coalesce(F.sum(c).over(here), F.lit(0)))
    return parts.drop("_first", "_at", "_part", *[f"{p}_{c}" for c in columns for p in ("_b", "_all")])
