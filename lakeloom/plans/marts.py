"""Sales mart: opportunities enriched with their account plus three derived
columns, and the metric definitions built on it.

Our definitions (the reference does not publish its formulas):
* ``days_to_close``          = close_date - created date (days; may be negative)
* ``pipeline_stage_bucket``  = stage -> early / late / won / lost, else unknown
* ``weighted_amount``        = amount x stage probability, decimal(18,2)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (our definitions): stage -> bucket, stage -> probability.
STAGE_BUCKET = {
    "Prospecting": "early",
    "Qualification": "early",
    "Negotiation": "late",
    "Closed Won": "won",
    "Closed Lost": "lost",
}
STAGE_PROBABILITY = {
    "Prospecting": "0.10",
    "Qualification": "0.25",
    "Negotiation": "0.60",
    "Closed Won": "1.00",
    "Closed Lost": "0.00",
}
ACCEPTED_STAGES = tuple(STAGE_BUCKET)


# Tags declared on the mart's derived columns, so masking travels with the
# data (column metadata survives aliases but not expressions).
MART_COLUMN_TAGS = {
    "amount": ("PII_FINANCIAL", "amount"),
    "weighted_amount": ("PII_FINANCIAL", "amount"),
    "arr": ("PII_FINANCIAL", "arr"),
}


def _lookup(mapping: dict, key: Column, cast: str | None = None) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    v = m[key]
    return v.cast(cast) if cast else v


def stage_bucket(stage: Column) -> Column:
    return F.coalesce(_lookup(STAGE_BUCKET, stage), F.lit("unknown"))


def weighted_amount(amount: Column, stage: Column) -> Column:
    return (amount * _lookup(STAGE_PROBABILITY, stage, "decimal(3,2)")).cast("decimal(18,2)")


def mart_opportunities(opportunities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Staged opportunities LEFT JOIN staged accounts on account_id.

    Left, so an orphan opportunity is kept (the relationships check reports
    it). No forced broadcast: the account side grows with the data, so the
    join strategy is left to AQE, which broadcasts only when the runtime size
    is under the threshold and splits skewed keys otherwise.
    """
    acc = accounts.select("account_id", "account_name", "industry", "customer_tier",
                          "billing_state", "arr")
    opp = opportunities.select("opportunity_id", "account_id", "owner_id", "stage_name",
                               "amount", "close_date", "created_date")
    j = opp.join(acc, "account_id", "left")
    return j.select(
        "opportunity_id", "account_id", "account_name", "industry", "customer_tier",
        "billing_state", "owner_id", "stage_name", "amount", "close_date", "created_date",
        F.datediff(F.col("close_date"), F.to_date("created_date")).alias("days_to_close"),
        stage_bucket(F.col("stage_name")).alias("pipeline_stage_bucket"),
        weighted_amount(F.col("amount"), F.col("stage_name")).alias("weighted_amount"),
    )


def pipeline_metrics(mart: DataFrame, by: tuple[str, ...] = ("pipeline_stage_bucket", "customer_tier")) -> DataFrame:
    """One definition of pipeline size and weighted pipeline, many consumers."""
    return mart.groupBy(*by).agg(
        F.count(F.lit(1)).alias("opportunities"),
        F.sum("amount").cast("decimal(38,2)").alias("total_amount"),
        F.sum("weighted_amount").cast("decimal(38,2)").alias("weighted_pipeline"),
        F.avg("days_to_close").cast("decimal(18,2)").alias("avg_days_to_close"),
    )


def seed_summary(accounts: DataFrame, table_fqn: str) -> DataFrame:
    """``'seeded ' || COUNT(*) || ' accounts into ' || table``."""
    return accounts.agg(F.concat(F.lit("seeded "), F.count(F.lit(1)).cast("string"),
                                 F.lit(f" accounts into {table_fqn}")).alias("result"))


def finance_bookings(mart: DataFrame) -> DataFrame:
    """Spoke mart built on the hub mart: won bookings by close month and industry."""
    won = mart.where((F.col("stage_name") == "Closed Won") & F.col("close_date").isNotNull())
    return won.groupBy(F.date_format("close_date", "yyyy-MM").alias("close_month"), "industry").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.sum("amount").cast("decimal(38,2)").alias("booked_amount"),
        F.count_distinct("account_id").alias("accounts"),
    )
