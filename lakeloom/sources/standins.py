"""Driver tables re-shaped into the inputs the engine consumes.

* ``events``   -> hourly landing files of JSON arrays (telemetry contract).
* ``orders``   -> change-captured opportunity feed (several versions per key).
* ``customer`` -> change-captured account feed.
* ``orders``   -> nested access history + query history (audit input).

The injection rules below are fixed values shared with the DuckDB oracles.
They mark records; they never drop any: every input row reaches the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Telemetry injection rules (on events.event_id).
NULL_USER_MOD = 97        # user_id is JSON null
EMPTY_ACCOUNT_MOD = 89    # account_id is ""
NO_TIMESTAMP_MOD = 83     # event_timestamp key absent
RESEND_MOD = 50           # the event is sent again in the next hour's file, properties.k + 1000
RESEND_K_OFFSET = 1000
ROWS_PER_FILE = 5000      # target records per landing file (larger hours split into chunks)

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sent(events: DataFrame) -> DataFrame:
    """One row per landed record: dt, hr, ts, n, copy and the columns its JSON is made of."""
    base = events.select(
        F.col("event_id").alias("n"), "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    resend = (base.where(F.col("n") % RESEND_MOD == 0)
              .withColumn("k", F.col("k") + RESEND_K_OFFSET)
              .withColumn("copy", F.lit(1))
              .withColumn("file_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    original = base.withColumn("copy", F.lit(0)).withColumn("file_ts", F.col("ts"))
    return original.unionByName(resend).select(
        F.date_format("file_ts", "yyyy-MM-dd").alias("dt"), F.date_format("file_ts", "HH").alias("hr"),
        "ts", "n", "copy", "user_id", "event_type", "value", "k")


def _json() -> Column:
    """The JSON of a row of ``_sent``."""
    n = F.col("n")
    user = F.when(n % NULL_USER_MOD == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("usr_"), F.col("user_id").cast("string")))
    account = F.when(n % EMPTY_ACCOUNT_MOD == 0, F.lit("")).otherwise(
        F.concat(F.lit("acct_"), F.col("user_id").cast("string")))
    common = [
        F.concat(F.lit("evt_"), n.cast("string")).alias("event_id"),
        user.alias("user_id"),
        account.alias("account_id"),
        F.col("event_type").alias("page_name"),
    ]
    tail = [
        F.concat(F.lit("sess_"), F.col("user_id").cast("string"), F.lit("_"),
                 F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.struct(F.col("k").alias("k"), F.col("value").alias("value")).alias("properties"),
    ]
    opts = {"ignoreNullFields": "false"}
    with_ts = F.to_json(F.struct(*common, F.date_format("ts", TS_FORMAT).alias("event_timestamp"), *tail), opts)
    without_ts = F.to_json(F.struct(*common, *tail), opts)
    return F.when(n % NO_TIMESTAMP_MOD == 0, without_ts).otherwise(with_ts)


def telemetry_records(events: DataFrame) -> DataFrame:
    """One row per landed record: (dt, hr, ts, n, copy, json)."""
    return _sent(events).select("dt", "hr", "ts", "n", "copy", _json().alias("json"))


# Drift injected into the telemetry records (on events.event_id).
NEW_KEY_MOD = 41          # properties.campaign, an object with an array, appears
RETYPED_MOD = 43          # session_id is a number
WIDENED_MOD = 47          # properties.k has a fraction


def drifted_records(events: DataFrame) -> DataFrame:
    """The telemetry records with a new, a retyped and a widened key in some."""
    n, json = F.col("n"), F.col("json")
    new = F.concat(F.lit('"properties":{"campaign":{"id":'), n.cast("string"), F.lit(',"tags":["a",null]},'))
    json = F.when(n % NEW_KEY_MOD == 0, F.replace(json, F.lit('"properties":{'), new)).otherwise(json)
    json = F.when(n % RETYPED_MOD == 0, F.regexp_replace(json, '"session_id":"[^"]*"', '"session_id":7')).otherwise(json)
    json = F.when(n % WIDENED_MOD == 0, F.regexp_replace(json, '"k":([0-9]+)', '"k":$1.5')).otherwise(json)
    return telemetry_records(events).withColumn("json", json)


def write_landing(events: DataFrame, landing_root: str, rows_per_file: int = ROWS_PER_FILE, hourly: bool = True) -> None:
    """Write records (a day's under hr=00 if not ``hourly``) as ``dt=YYYY-MM-DD/hr=HH/chunk=C/*.txt``, each file one JSON array.

    An hour holding more than ``rows_per_file`` records is split into
    ``ceil(count / rows_per_file)`` chunks by ``n % chunks``, so a hot hour is
    numbered and written by several tasks, never by one. Records are numbered
    inside their chunk to place the array brackets.
    """
    landing_lines(events, rows_per_file, hourly).write.partitionBy("dt", "hr", "chunk").mode("errorifexists").text(landing_root)


def landing_lines(events: DataFrame, rows_per_file: int = ROWS_PER_FILE, hourly: bool = True) -> DataFrame:
    """(dt, hr, chunk, value): the lines of the landing files, each file's in order in one
    partition. The JSON is made behind the one shuffle, which carries the plain columns."""
    rec = _sent(events)
    if not hourly:
        rec = rec.withColumn("hr", F.lit("00"))
    per_hour = rec.groupBy("dt", "hr").agg(F.count(F.lit(1)).alias("_count"))
    rec = (rec.join(per_hour, ["dt", "hr"])
              .withColumn("chunk", F.pmod(F.col("n"), F.ceil(F.col("_count") / F.lit(rows_per_file)))).drop("_count"))
    w = Window.partitionBy("dt", "hr", "chunk").orderBy("ts", "n", "copy")
    rec = rec.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead("copy").over(w).isNull())
    line = F.concat(F.when(F.col("_first"), F.lit("[")).otherwise(F.lit(",")), _json(),
                    F.when(F.col("_last"), F.lit("]")).otherwise(F.lit("")))
    return rec.select("dt", "hr", "chunk", line.alias("value"))


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one file under this very name, over an older one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


# Files of every verdict, beside the landed ones.
ODD_FILES = {
    "dt=1999-01-01/hr=01/chunk=broken/f.txt": '[{"event_id": "evt_x"',
    "dt=1999-01-01/hr=02/chunk=object/f.txt": '{"event_id": "evt_x"}',
    "dt=1999-01-01/hr=03/chunk=empty/f.txt": "[]",
    "dt=1999-01-01/hr=04/chunk=nothing/f.txt": "",
    "undated/chunk=late/f.txt": '[{"event_id": "evt_u"}, 5]',
}
CORRECTED = ("dt=1999-01-01/hr=01/chunk=broken/f.txt", '[{"event_id": "evt_x"}]')


# ---------------------------------------------------------------- CDC feeds

# Stage names by order priority, and the messy spellings.
PRIORITY_STAGE = {
    "1-URGENT": "Closed Won",
    "2-HIGH": "Negotiation",
    "3-MEDIUM": "Qualification",
    "4-NOT SPECIFIED": "Prospecting",
    "5-LOW": "Closed Lost",
}
OLD_VERSION_MOD = 4      # an older version exists (earlier sync, stage Prospecting)
TIE_SYNC_MOD = 13        # a second version with the same sync time, older modification
DELETED_MOD = 11         # soft-deleted when the order status is P
ORPHAN_MOD = 997         # account id points to no account
NULL_AMOUNT_MOD = 101
NULL_CLOSE_MOD = 103
ACCOUNT_OLD_MOD = 5      # accounts with an older version


def _stage(priority: F.Column) -> F.Column:
    m = F.create_map(*[x for kv in PRIORITY_STAGE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[priority]


def opportunity_feed(orders: DataFrame) -> DataFrame:
    """CDC replica of opportunities (several versions per key)."""
    k = F.col("o_orderkey")
    stage = _stage(F.col("o_orderpriority"))
    messy = (F.when(k % 3 == 0, F.concat(F.lit("  "), F.lower(stage), F.lit(" ")))
             .when(k % 3 == 1, F.upper(F.regexp_replace(stage, " ", "\t ")))
             .otherwise(stage))
    created = F.col("o_orderdate")
    synced = created + F.expr("INTERVAL 30 DAYS")
    current = orders.select(
        F.concat(F.lit("opp_"), k.cast("string")).alias("opportunity_id"),
        F.when(k % ORPHAN_MOD == 0, F.concat(F.lit("acct_missing_"), k.cast("string")))
         .otherwise(F.concat(F.lit("acct_"), F.col("o_custkey").cast("string"))).alias("account_id"),
        F.concat(F.lit("own_"), (k % 7).cast("string")).alias("owner_id"),
        messy.alias("stage_name"),
        F.when(k % NULL_AMOUNT_MOD == 0, F.lit(None))
         .otherwise(F.col("o_totalprice")).cast("decimal(18,2)").alias("amount"),
        F.when(k % NULL_CLOSE_MOD == 0, F.lit(None))
         .otherwise(F.date_add(F.to_date(created), (k % 200).cast("int") - 20)).alias("close_date"),
        created.alias("created_date"),
        (created + F.expr("INTERVAL 20 DAYS")).alias("last_modified_date"),
        ((F.col("o_orderstatus") == "P") & (k % DELETED_MOD == 0)).alias("is_deleted"),
        synced.alias("_fivetran_synced"),
        k.alias("_k"),
    )
    older = (current.where(F.col("_k") % OLD_VERSION_MOD == 0)
             .withColumn("stage_name", F.lit("Prospecting"))
             .withColumn("amount", (F.col("amount") / 2).cast("decimal(18,2)"))
             .withColumn("is_deleted", F.lit(False))
             .withColumn("last_modified_date", F.col("created_date"))
             .withColumn("_fivetran_synced", F.col("created_date") + F.expr("INTERVAL 1 DAYS")))
    tie = (current.where(F.col("_k") % TIE_SYNC_MOD == 0)
           .withColumn("stage_name", F.lit("Qualification"))
           .withColumn("last_modified_date", F.col("created_date") + F.expr("INTERVAL 10 DAYS")))
    return current.unionByName(older).unionByName(tie).drop("_k")


def account_feed(customer: DataFrame) -> DataFrame:
    """CDC replica of accounts (older versions for some keys)."""
    k = F.col("c_custkey")
    bal = F.col("c_acctbal")
    tier = F.when(bal >= 5000, "Enterprise").when(bal >= 1000, "Mid-Market").otherwise("SMB")
    created = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(
        F.lit(0), F.lit(0), k.cast("int"), F.lit(0))
    current = customer.select(
        F.concat(F.lit("acct_"), k.cast("string")).alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.initcap(F.col("c_mktsegment")).alias("industry"),
        bal.cast("decimal(18,2)").alias("arr"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("billing_state"),
        tier.alias("customer_tier"),
        created.alias("created_date"),
        F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")).alias("_fivetran_synced"),
        k.alias("_k"),
    )
    older = (current.where(F.col("_k") % ACCOUNT_OLD_MOD == 0)
             .withColumn("arr", F.lit(0).cast("decimal(18,2)"))
             .withColumn("customer_tier", F.lit("SMB"))
             .withColumn("_fivetran_synced", F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00"))))
    return current.unionByName(older).drop("_k")


# ------------------------------------------------------------ audit inputs

# Objects and columns a query touches, by order priority.
ACCOUNT_FQN = "PROD_DB.SALESFORCE_RAW_FIVETRAN.ACCOUNT"
OPPORTUNITY_FQN = "PROD_DB.SALESFORCE_RAW_FIVETRAN.OPPORTUNITY"
MART_FQN = "PROD_DB.MARTS_REVOPS.MART_REVOPS__PIPELINE"
STATUS_ROLE = {"F": "REVOPS_ADMIN", "O": "REVOPS_ANALYST", "P": "REVOPS_READER"}


def access_history(orders: DataFrame) -> DataFrame:
    """One query per order; the objects/columns read depend on its priority."""
    k = F.col("o_orderkey")
    pr = F.col("o_orderpriority")

    def obj(name: str, *cols: str) -> F.Column:
        return F.struct(F.lit(name).alias("objectName"),
                        F.array(*[F.struct(F.lit(c).alias("columnName")) for c in cols]).alias("columns"))

    objects = (F.when(pr == "1-URGENT", F.array(obj(ACCOUNT_FQN, "ACCOUNT_NAME", "ARR"), obj(OPPORTUNITY_FQN, "AMOUNT")))
               .when(pr == "2-HIGH", F.array(obj(ACCOUNT_FQN, "ARR")))
               .when(pr == "3-MEDIUM", F.array(obj(ACCOUNT_FQN, "ACCOUNT_NAME", "INDUSTRY")))
               .when(pr == "4-NOT SPECIFIED", F.array(obj(MART_FQN, "ARR", "AMOUNT")))
               .otherwise(F.array(obj(OPPORTUNITY_FQN, "AMOUNT", "STAGE_NAME"), obj(ACCOUNT_FQN, "ARR", "BILLING_STATE"))))
    return orders.select(
        F.concat(F.lit("q"), k.cast("string")).alias("query_id"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))).alias("query_start_time"),
        F.concat(F.lit("USER_"), (F.col("o_custkey") % 20).cast("string")).alias("user_name"),
        objects.alias("base_objects_accessed"),
    )


def query_history(orders: DataFrame) -> DataFrame:
    m = F.create_map(*[x for kv in STATUS_ROLE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return orders.select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("query_id"),
                         m[F.col("o_orderstatus")].alias("role_name"))
