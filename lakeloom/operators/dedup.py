"""Latest row per key (QUALIFY ROW_NUMBER() OVER (... ORDER BY ... DESC) = 1).

Written as a window over a descending order, of which the first row is kept: Spark then
keeps that row per key in each task before the shuffle (WindowGroupLimit), so a hot key
(or many resends of one id) is reduced per task, and copies nothing but the rows that
stay. A hash of the key comes first in the sort, as most comparisons end at its eight
bytes. Ties on the first order column fall through to the next ones; give enough order
columns to make the order unique per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, in one scan and one shuffle.

    NULL keys behave as in ``PARTITION BY``: they form one group and keep one
    row (staging filters contract-invalid rows, so event ids are never NULL
    there). A large NULL group is no skew risk: it is reduced per task.
    """
    values = [c for c in df.columns if c not in keys]
    if not values:
        return df.select(*keys).distinct()
    w = Window.partitionBy("_key_hash", *keys).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumn("_key_hash", F.xxhash64(*keys)).withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") == 1).select(*keys, *values)


def latest_by_key_window(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same operator without the hash;
    kept for comparison in the bench and for callers that need it."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
