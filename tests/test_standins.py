from pyspark.sql import functions as F

from lakeloom.config import EVENTS
from lakeloom.operators import commit as C
from lakeloom.plans.ingest import ingest
from lakeloom.sources import standins as S
from lakeloom.sources.landing import ScanScope

SF = "/root/testdata/sf0.001"


def test_hot_hours_split_into_valid_files(spark, tmp_root):
    events = S.table(spark, SF, "events")
    root = f"{tmp_root}/landing"
    S.write_landing(events, root, rows_per_file=3)
    wh = f"{tmp_root}/wh"
    res = ingest(spark, EVENTS["product_events"], root, wh, ScanScope.backfill())
    statuses = {r.status for r in res.report.collect()}
    assert statuses == {"loaded"}  # every chunk file is a well-formed array
    n = events.count() + events.where(F.col("event_id") % S.RESEND_MOD == 0).count()
    assert C.committed(spark, wh, C.RAW).count() == n  # whole result, nothing dropped
    biggest = C.committed(spark, wh, C.LOAD_LOG).agg(F.max("records_processed")).first()[0]
    assert biggest <= 6


def test_lines_are_shuffled_once_and_made_behind_the_shuffle(spark):
    plan = S.landing_lines(S.table(spark, SF, "events"))._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "chunk#" in line]
    assert len(rows) == 1
    assert "to_json" not in plan[plan.index(rows[0]):]
