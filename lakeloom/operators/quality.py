"""Data-quality checks, evaluated as few passes as possible.

Row-level checks on one model (not_null, accepted_values, expression) share
one aggregate pass; unique is one group-by; relationships is one anti-join.
The result is one summary row per check; ``assert_checks`` blocks a build on
any failing error-severity check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KINDS = ("not_null", "unique", "accepted_values", "relationships", "expression", "pattern", "conditional_reference",
         "one_per_group", "empty")
SUMMARY_COLUMNS = ["check_name", "model", "check_type", "failures", "severity", "status"]


@dataclass(frozen=True)
class Check:
    name: str
    model: str
    kind: str                      # one of KINDS; empty: every row of the model is a failure
    columns: tuple[str, ...] = ()
    values: tuple = ()
    to_model: str | None = None
    to_column: str | None = None
    condition: str | None = None   # expression: SQL predicate that flags a failing row
    severity: str = "error"        # error | warn
    threshold: int = 0             # failures allowed before the check fails


def not_null(model: str, column: str, **kw) -> Check:
    return Check(f"not_null_{model}_{column}", model, "not_null", (column,), **kw)


def unique(model: str, *columns: str, **kw) -> Check:
    return Check(f"unique_{model}_{'_'.join(columns)}", model, "unique", tuple(columns), **kw)


def accepted_values(model: str, column: str, values, **kw) -> Check:
    return Check(f"accepted_values_{model}_{column}", model, "accepted_values", (column,), tuple(values), **kw)


def relationships(model: str, column: str, to_model: str, to_column: str, **kw) -> Check:
    return Check(f"relationships_{model}_{column}__{to_model}_{to_column}", model, "relationships",
                 (column,), to_model=to_model, to_column=to_column, **kw)


def expression(name: str, model: str, failing_when: str, **kw) -> Check:
    """Singular/pattern check: rows matching the predicate fail."""
    return Check(name, model, "expression", condition=failing_when, **kw)


def empty(name: str, model: str, **kw) -> Check:
    """Singular test: the model, any DataFrame, must have no row."""
    return Check(name, model, "empty", **kw)


def pattern(model: str, column: str, regex: str, **kw) -> Check:
    """Non-null values must match the regular expression."""
    return Check(f"pattern_{model}_{column}", model, "pattern", (column,), condition=regex, **kw)


def conditional_reference(model: str, column: str, to_model: str, to_column: str, when: str, **kw) -> Check:
    """Rows that match ``when`` need a parent; a null reference is a failure there."""
    return Check(f"conditional_reference_{model}_{column}", model, "conditional_reference", (column,),
                 to_model=to_model, to_column=to_column, condition=when, **kw)


def one_per_group(model: str, column: str, when: str, **kw) -> Check:
    """Each value of ``column`` has exactly one row that matches ``when``."""
    return Check(f"one_per_group_{model}_{column}", model, "one_per_group", (column,), condition=when, **kw)


def _row_failure(c: Check):
    if c.kind == "empty":
        return F.lit(True)
    if c.kind == "pattern":
        return F.col(c.columns[0]).isNotNull() & ~F.col(c.columns[0]).rlike(c.condition)
    if c.kind == "not_null":
        return F.col(c.columns[0]).isNull()
    if c.kind == "accepted_values":
        col = F.col(c.columns[0])
        return col.isNotNull() & ~col.isin(list(c.values))
    if c.kind == "expression":
        return F.coalesce(F.expr(c.condition), F.lit(False))
    return None


def _summary(counts: DataFrame, checks: list[Check]) -> DataFrame:
    """Wide one-row counts -> one row per check."""
    rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.lit(c.model).alias("model"),
                              F.lit(c.kind).alias("check_type"),
                              F.col(f"`{c.name}`").cast("long").alias("failures"),
                              F.lit(c.severity).alias("severity"),
                              F.lit(c.threshold).cast("long").alias("threshold"))
                     for c in checks])
    return counts.select(F.inline(rows))


def is_row_check(c: Check) -> bool:
    return _row_failure(c) is not None


def observed(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, Observation | None]:
    """``df`` whose next write also counts the failing rows of the row checks."""
    rows = [c for c in checks if is_row_check(c)]
    if not rows:
        return df, None
    seen = Observation()
    return df.observe(seen, *[F.count(F.when(_row_failure(c), F.lit(1))).alias(c.name) for c in rows]), seen


def written_summary(spark: SparkSession, checks: list[Check], seen: dict[str, Observation | None], models: dict[str, DataFrame]) -> DataFrame:
    """The summary after the models were written: row checks from what the writes have
    counted, the others (unique, references, one per group) from the written data."""
    counted = [(c.name, c.model, c.kind, int(seen[c.model].get[c.name]), c.severity, c.threshold) for c in checks if is_row_check(c)]
    parts = []
    if counted:
        rows = spark.createDataFrame(counted, "check_name string, model string, check_type string, failures long, severity string, threshold long")
        parts.append(_judged(rows))
    if rest := [c for c in checks if not is_row_check(c)]:
        parts.append(run_checks(models, rest))
    out = parts[0] if parts else no_checks(spark)
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def _judged(counts: DataFrame) -> DataFrame:
    failures = F.coalesce(F.col("failures"), F.lit(0)).cast("long")
    status = F.when(failures <= F.col("threshold"), "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    return counts.withColumn("status", status).withColumn("failures", failures).select(*SUMMARY_COLUMNS)


def run_checks(models: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """One summary row per check.

    Per model, the row-level checks and (at most) one unique check share a
    single pass: group by the unique key (no extra shuffle when the model is
    already partitioned by it, as staged models are), count rows and failing
    rows per key, then sum. Relationships are one anti-join each.
    """
    if unknown := [c for c in checks if c.kind not in KINDS]:
        raise ValueError(f"unknown check kinds: {sorted({c.kind for c in unknown})}")
    parts: list[DataFrame] = []
    by_model: dict[str, list[Check]] = {}
    for c in checks:
        if _row_failure(c) is not None or c.kind == "unique":
            by_model.setdefault(c.model, []).append(c)
    for model, cs in by_model.items():
        df = models[model]
        row_checks = [c for c in cs if c.kind != "unique"]
        uniques = [c for c in cs if c.kind == "unique"]
        folded = uniques[0] if uniques else None
        if folded is not None:
            keys = list(folded.columns)
            per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                                            *[F.count_if(_row_failure(c)).alias(c.name) for c in row_checks])
            key_ok = F.lit(True)
            for k in keys:
                key_ok = key_ok & F.col(k).isNotNull()
            counts = per_key.agg(F.count_if(key_ok & (F.col("_rows") > 1)).alias(folded.name),
                                 *[F.sum(c.name).alias(c.name) for c in row_checks])
            parts.append(_summary(counts, [folded] + row_checks))
        elif row_checks:
            counts = df.agg(*[F.count_if(_row_failure(c)).alias(c.name) for c in row_checks])
            parts.append(_summary(counts, row_checks))
        for c in uniques[1:]:
            dup = df.groupBy(*c.columns).count().where(F.col("count") > 1)
            for k in c.columns:
                dup = dup.where(F.col(k).isNotNull())
            parts.append(_summary(dup.agg(F.count(F.lit(1)).alias(c.name)), [c]))
    for c in checks:
        if c.kind == "relationships":
            child = models[c.model].where(F.col(c.columns[0]).isNotNull())
            parent = models[c.to_model].select(F.col(c.to_column).alias("_parent_key"))
            orphans = child.join(parent, child[c.columns[0]] == parent["_parent_key"], "left_anti")
            parts.append(_summary(orphans.agg(F.count(F.lit(1)).alias(c.name)), [c]))
        elif c.kind == "conditional_reference":
            child = models[c.model].where(F.coalesce(F.expr(c.condition), F.lit(False)))
            parent = models[c.to_model].select(F.col(c.to_column).alias("_parent_key"))
            orphans = child.join(parent, child[c.columns[0]] == parent["_parent_key"], "left_anti")
            parts.append(_summary(orphans.agg(F.count(F.lit(1)).alias(c.name)), [c]))
        elif c.kind == "one_per_group":
            hits = models[c.model].groupBy(c.columns[0]).agg(F.count_if(F.coalesce(F.expr(c.condition), F.lit(False))).alias("_hits"))
            parts.append(_summary(hits.agg(F.count_if(F.col("_hits") != 1).alias(c.name)), [c]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _judged(out)


def no_checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "check_name string, model string, check_type string, failures long, severity string, status string")


class QualityError(RuntimeError):
    """``summary``: the checks run so far, one row each."""

    def __init__(self, message: str, summary: DataFrame):
        super().__init__(message)
        self.summary = summary


def assert_checks(summary: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Raise when any error-severity check fails (blocks the build). ``before``: the
    summary of earlier layers, which is put in front."""
    failing = summary.where(F.col("status") == "fail").select("check_name", "failures").collect()
    if failing:
        raise QualityError("failing checks: " + ", ".join(f"{r.check_name}={r.failures}" for r in failing),
                           summary if before is None else before.unionByName(summary))
    return summary if before is None else before.unionByName(summary)
