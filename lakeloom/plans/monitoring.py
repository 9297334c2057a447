"""Load monitoring over the load log and RAW: reject rate, freshness, drift of the
payload's top-level keys and of its nested paths and types."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.config import EventSpec
from lakeloom.operators.commit import ts_literal


def reject_rate(log: DataFrame, by: tuple[str, ...] = ("_batch_id",), threshold: float | None = None) -> DataFrame:
    """Quarantined / processed per group, alertable against a threshold."""
    out = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("records_processed").cast("long").alias("records_processed"),
        F.sum("records_quarantined").cast("long").alias("records_quarantined"),
    ).withColumn("reject_rate", F.try_divide(F.col("records_quarantined").cast("decimal(20,0)"),
                                             F.col("records_processed")).cast("decimal(12,6)"))
    if threshold is not None:
        out = out.withColumn("alert", F.col("reject_rate") > F.lit(threshold))
    return out


def freshness(df: DataFrame, column: str, now: datetime, sla_hours: float,
              by: tuple[str, ...] = ()) -> DataFrame:
    """Newest value of a load/event time against an SLA (per group)."""
    latest = F.max(column)
    lag_us = F.timestamp_diff("MICROSECOND", latest, ts_literal(now))  # time-zone free on NTZ
    lag = (lag_us.cast("decimal(20,0)") / F.lit(3600000000)).cast("decimal(18,3)")
    return df.groupBy(*by).agg(latest.alias("latest"), lag.alias("lag_hours")).withColumn(
        "status", F.when(F.col("latest").isNull(), "no data")
        .when(F.col("lag_hours") <= sla_hours, "fresh").otherwise("stale"))


def drift_report(raw: DataFrame, spec: EventSpec) -> DataFrame:
    """Top-level payload keys seen against the registered contract.

    ``contract``: required key; ``known``: registered optional key;
    ``additive``: new key (surface it, land it, never alter the table).
    ``records_without`` counts records lacking the key; for a required key
    these are breaking (quarantined at load). Contract keys never seen are
    listed too. Two aggregate passes, no per-record driver work.
    """
    keys = F.map_keys(F.try_variant_get("payload", "$", "map<string,variant>"))
    with_keys = raw.select(keys.alias("_keys"))
    seen = with_keys.select(F.explode("_keys").alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("records_with_key"))
    known = list(dict.fromkeys(list(spec.required) + list(spec.contract_keys)))
    # One aggregate pass: the total and, per contract key, the records lacking
    # it. The result is one row of config-sized width.
    counts = with_keys.agg(F.count(F.lit(1)).alias("_total"),
                           *[F.count_if(~F.coalesce(F.array_contains("_keys", k), F.lit(False))).alias(k)
                             for k in known]).first()
    contract = raw.sparkSession.createDataFrame([(k, int(counts[k])) for k in known],
                                                "key string, _without long")
    status = (F.when(F.col("key").isin(list(spec.required)), "contract")
              .when(F.col("key").isin(known), "known").otherwise("additive"))
    return seen.join(contract, "key", "full").select(
        "key", F.coalesce("records_with_key", F.lit(0)).cast("long").alias("records_with_key"),
        status.alias("status"),
        F.coalesce("_without", F.lit(int(counts["_total"])) - F.col("records_with_key"))
         .cast("long").alias("records_without"))


#: Parts of a shape as ``schema_of_variant`` writes it: a key (quoted where it isn't
#: plain) with its colon, an opening or closing type, a scalar type (without a
#: decimal's digits, which say nothing about a contract).
SHAPE_PARTS = r"(?:`(?:[^`]|``)*`|\w+):|OBJECT<|ARRAY<|[A-Z][A-Z_ ]*|>"
#: Numbers widen in this order; every other type fits itself alone.
NUMBER_ORDER = ("BIGINT", "DECIMAL", "DOUBLE")


def shape_paths(shape: Column) -> Column:
    """Every path of a variant's shape with its type, as an array of structs: ``$`` is
    the value itself, ``a.b`` a key of an object, ``a[]`` an array's elements. Keys that
    aren't plain stay in backticks. A fold over the shape's parts; the accumulator
    holds the open paths, the path the next type belongs to, and what was found."""

    def step(acc: Column, part: Column) -> Column:
        named, opened = part.endswith(":"), part.endswith("<")
        top, key = F.element_at(acc["open"], -1), F.regexp_replace(part, ":$", "")
        below = F.when(top == "$", key).otherwise(F.concat(top, F.lit("."), key))
        found = F.array(F.struct(acc["at"].alias("path"), F.regexp_replace(part, "<$", "").alias("type")))
        return F.struct(
            F.when(opened, F.concat(acc["open"], F.array(acc["at"])))
             .when(part == ">", F.slice(acc["open"], 1, F.size(acc["open"]) - 1))
             .otherwise(acc["open"]).alias("open"),
            F.when(named, below).when(opened, F.concat(acc["at"], F.lit("[]"))).otherwise(acc["at"]).alias("at"),
            F.when(named | (part == ">"), acc["found"]).otherwise(F.concat(acc["found"], found)).alias("found"))

    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("open"), F.lit("$").alias("at"),
                     F.expr("CAST(array() AS array<struct<path: string, type: string>>)").alias("found"))
    return F.aggregate(F.regexp_extract_all(shape, F.lit(SHAPE_PARTS), F.lit(0)), start, step, lambda acc: acc["found"])


def nested_drift(raw: DataFrame, contract: dict[str, str], payload: str = "payload") -> DataFrame:
    """Every payload path seen, at any depth, against the contract's types.

    ``contract`` maps paths (see ``shape_paths``) to ``BIGINT DECIMAL DOUBLE STRING
    BOOLEAN OBJECT ARRAY``. One row per path: ``types`` (seen, in order, without nulls),
    ``merged_type`` (the widest number, the only type, ``VARIANT`` where types do not
    merge, null if only nulls were seen), ``records_with``, ``records_null``,
    ``records_without`` and ``status``:

    * ``same``: only types that fit the contract's (a whole number fits a double);
    * ``widened``: numbers wider than the contract's, which no reader of the wider
      type loses (additive);
    * ``additive``: a path the contract does not have;
    * ``breaking``: a type that does not fit the contract's and doesn't widen it;
    * ``missing``: a contract path that no record has.

    The payloads are read once and grouped by shape before anything is taken apart,
    so paths are counted over distinct shapes; nothing passes the driver. Null
    payloads count as records without any path. A path inside an array counts a
    record once however many elements have it. An empty table gives the contract's
    paths as missing.
    """
    shapes = raw.select(F.schema_of_variant(payload).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).scalar()
    seen = shapes.select("n", F.explode(shape_paths(F.col("shape"))).alias("_")).select("n", "_.path", "_.type")
    null = F.col("type") == "VOID"
    paths = seen.where(F.col("path") != "$").groupBy("path").agg(
        F.sum("n").alias("records_with"),
        F.sum(F.when(null, F.col("n")).otherwise(0)).alias("records_null"),
        F.array_sort(F.collect_set(F.when(~null, F.col("type")))).alias("types"))
    spec = raw.sparkSession.createDataFrame(list(contract.items()), "path string, contract_type string")
    order = F.array(*[F.lit(t) for t in NUMBER_ORDER])
    numbers = F.forall("types", lambda t: F.array_contains(order, t))
    widest = F.array_max(F.transform("types", lambda t: F.array_position(order, t)))
    allowed = F.array_position(order, F.col("contract_type"))
    both_numbers = numbers & (allowed > 0)
    status = (F.when(F.col("records_with").isNull(), "missing")
              .when(F.col("contract_type").isNull(), "additive")
              .when(F.size("types") == 0, "same")
              .when(both_numbers, F.when(widest <= allowed, "same").otherwise("widened"))
              .when((F.size("types") == 1) & (F.col("types")[0] == F.col("contract_type")), "same")
              .otherwise("breaking"))
    merged = (F.when(F.size("types") == 0, F.lit(None).cast("string"))
              .when(numbers, F.element_at(order, widest.cast("int")))
              .when(F.size("types") == 1, F.col("types")[0])
              .when(F.size("types") > 1, "VARIANT"))
    have = F.coalesce("records_with", F.lit(0)).cast("long")
    return paths.join(spec, "path", "full").select(
        "path", F.coalesce(F.array_join("types", ","), F.lit("")).alias("types"), merged.alias("merged_type"),
        have.alias("records_with"), F.coalesce("records_null", F.lit(0)).cast("long").alias("records_null"),
        (total - have).cast("long").alias("records_without"), status.alias("status"))
