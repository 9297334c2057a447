"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so a batch of changes is
folded into them as signed deltas and nothing is counted again:

* ``insert``: +1 document, +n_tokens;
* ``delete``: -1 document, -n_tokens (the count that was inserted);
* ``revise``: n_tokens - old_n_tokens, and no document.

A store is a folder of the shared file system. A commit aggregates its batch to one row
per group (partial sums first, so a group with a third of all rows costs one row per
task) and writes it to a folder of its own; then one row in ``commits`` names the batch
and that folder. A batch whose id is among the commits is not applied again, and what
an attempt wrote before it failed is in no commit and is never read. If two attempts of
one batch commit at the same time, readers take one of them, the smallest folder name.
``totals`` sums the committed deltas; ``compact`` replaces the deltas of many commits by
one, in the same way. As with any file store, a batch id must come from one source of
batches.

Defined cases: null source, language or tokenizer are groups of their own. A null count
is 0. An unknown or null operation fails the commit, and nothing of that batch is
applied. Repeated change rows count each; an empty batch commits nothing but its id.
Groups whose documents and tokens both come to 0 are left out of ``totals``. Other
columns are not read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import shared_folder

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"
COMMITS = "batch_id string, folder string, replaces array<string>"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per group of changes (KEYS, op, n_tokens, old_n_tokens)."""
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_n_tokens", F.lit(0)).cast("long")
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(
        F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "revise", n - old).otherwise(sign * n)
    return changes.select(*KEYS, sign.cast("long").alias("documents"), tokens.alias("tokens")).groupBy(*KEYS).agg(
        F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class RollupStore:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "token-rollup")

    def _note(self, batch_id: str, folder: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(batch_id, folder, replaces)], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def commits(self) -> DataFrame:
        """The standing commits, a row per batch: batch_id, folder."""
        if not self._exists():
            return self.spark.createDataFrame([], "batch_id string, folder string")
        noted = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")
        # Of compactions that replace a batch in common the earliest stands; the others count for nothing.
        replaced = noted.select("batch_id", F.explode("replaces").alias("batch"))
        first = replaced.groupBy("batch").agg(F.min("batch_id").alias("first"))
        void = replaced.join(first, "batch").where("batch_id <> first").select("batch_id").distinct()
        noted = noted.join(void, "batch_id", "left_anti")
        gone = noted.select(F.explode("replaces").alias("batch_id"))
        return noted.groupBy("batch_id").agg(F.min("folder").alias("folder")).join(gone, "batch_id", "left_anti")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def has(self, batch_id: str) -> bool:
        if not self._exists():
            return False
        noted = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")
        return not noted.where(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if self.has(batch_id):
            return False
        folder = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(folder)
        self._note(batch_id, folder, [])
        return True

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTAS)
        return self.spark.read.schema(DELTAS).parquet(*folders).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """Over one folder per commit since the last compaction."""
        folders = sorted(r["folder"] for r in self.commits().toLocalIterator())
        return self._sum(folders).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Replace the deltas of all commits by their sum; batch ids stay known."""
        started = time.time_ns()
        standing = sorted((r["folder"], r["batch_id"]) for r in self.commits().toLocalIterator())
        folders, batch_ids = [f for f, _ in standing], [b for _, b in standing]
        if len(folders) < 2:
            return
        folder = f"{self.folder}/deltas/{uuid.uuid4().hex}"
        self._sum(folders).write.parquet(folder)
        self._note(f"compaction-{started:020d}-{uuid.uuid4().hex}", folder, batch_ids)
