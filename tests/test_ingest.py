"""Telemetry load goldens (re-derived from the reference samples) and the
cases the samples lack."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import F_A, F_B, write_json
from lakeloom.config import EVENTS
from lakeloom.operators import commit as C
from lakeloom.plans.ingest import NOT_AN_ARRAY, IngestError, WholeFiles, ingest, raw_rows, retry_failed
from lakeloom.plans.staging import stg_events
from lakeloom.sources.landing import ScanScope

SPEC = EVENTS["page_views"]


def _log(spark, wh):
    return {r.file_name: (r.records_processed, r.records_quarantined)
            for r in C.committed(spark, wh, C.LOAD_LOG).collect()}


def test_first_load_golden(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    res = ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill())
    assert _log(spark, wh) == {F_A: (3, 1), F_B: (9, 5)}
    raw = C.committed(spark, wh, C.RAW)
    assert raw.count() == 12
    reasons = sorted(r.reason for r in C.committed(spark, wh, C.QUARANTINE).collect())
    assert reasons == sorted([
        "missing/null required field(s): user_id",
        "missing/null required field(s): user_id",
        "missing/null required field(s): event_id",
        "missing/null required field(s): account_id",
        "missing/null required field(s): account_id",
        "missing/null required field(s): event_timestamp",
    ])
    t = res.totals().first()
    assert (t.files_loaded, t.rows_loaded, t.rows_quarantined) == (2, 12, 6)
    assert sorted((r.file_name, r.status) for r in res.report.collect()) == [(F_A, "loaded"), (F_B, "loaded")]
    # Promoted keys are best effort; the full set lands (invalid rows too).
    row = raw.where(F.col("_filename") == F_A).where(F.col("_pos") == 0).first()
    assert row.event_id == "click-1" and row.event_timestamp == datetime(2026, 3, 14, 20, 5, 30)


def test_rerun_is_noop_and_force_doubles(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill())
    again = ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill())
    assert again.batch_id is None
    assert again.totals().first().files_loaded == 0
    assert {r.status for r in again.report.collect()} == {"skipped"}
    ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill(), force=True)
    assert C.committed(spark, wh, C.RAW).count() == 24
    assert C.committed(spark, wh, C.QUARANTINE).count() == 12
    assert C.committed(spark, wh, C.LOAD_LOG).count() == 4


def test_staging_after_load_and_after_force(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill())
    ids = sorted(r.event_id for r in stg_events(C.committed(spark, wh, C.RAW), SPEC).collect())
    assert ids == ["click-1", "click-11", "click-12", "click-3"]
    ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill(), force=True)
    stg = stg_events(C.committed(spark, wh, C.RAW), SPEC)
    assert sorted(r.event_id for r in stg.collect()) == ["click-1", "click-11", "click-12", "click-3"]
    d = stg.where(F.col("event_id") == "click-1").first()
    assert (d.browser, d.module, d.duration_ms) == ("Lynx", None, 77)


def test_contract_edge_cases(spark, tmp_root):
    root = f"{tmp_root}/landing"
    write_json(f"{root}/dt=2026-05-02/hr=00/a.json", [
        {"event_id": "x1", "account_id": "a", "event_timestamp": "2026-05-02T00:00:00Z"},   # two keys missing
        {"event_id": " ", "account_id": "0", "event_timestamp": "2026-05-02T00:00:01+05:30", "user_id": False},
        {"event_id": 7, "account_id": "a", "event_timestamp": "2026-05-02T00:00:02Z", "user_id": "u"},
        {"event_id": "x4", "account_id": "", "event_timestamp": "not a time", "user_id": "u"},
        5,
        None,
    ])
    wh = f"{tmp_root}/wh"
    ingest(spark, SPEC, root, wh, ScanScope.backfill())
    raw = {r._pos: r for r in C.committed(spark, wh, C.RAW).collect()}
    assert raw[0]._reason == "missing/null required field(s): user_id"
    assert raw[1]._reason is None  # whitespace, "0" and false pass
    assert raw[1].event_timestamp == datetime(2026, 5, 2, 0, 0, 1)  # offset dropped, wall clock kept
    assert raw[2]._reason is None and raw[2].event_id == "7"  # number renders as text
    assert raw[3]._reason == "missing/null required field(s): account_id; invalid event_timestamp"
    everything = "missing/null required field(s): event_id, account_id, event_timestamp, user_id"
    assert raw[4]._reason == everything and raw[5]._reason == everything


def test_two_missing_keys_in_contract_order(spark, tmp_root):
    root = f"{tmp_root}/landing"
    write_json(f"{root}/dt=2026-05-02/hr=01/a.json", [{"user_id": "u", "event_id": "e"}])
    wh = f"{tmp_root}/wh"
    ingest(spark, SPEC, root, wh, ScanScope.backfill())
    q = C.committed(spark, wh, C.QUARANTINE).collect()
    assert [r.reason for r in q] == ["missing/null required field(s): account_id, event_timestamp"]


def test_file_verdicts_and_retry(spark, tmp_root):
    root = f"{tmp_root}/landing"
    write_json(f"{root}/dt=2026-05-03/hr=00/empty.json", "[]")
    write_json(f"{root}/dt=2026-05-03/hr=00/bad.json", "[{\"event_id\": ")
    write_json(f"{root}/dt=2026-05-03/hr=00/object.json", {"event_id": "x"})
    write_json(f"{root}/undated/file.json", [{"event_id": "u1", "account_id": "a",
                                              "event_timestamp": "2026-05-03T00:00:00Z", "user_id": "u"}])
    wh = f"{tmp_root}/wh"
    res = ingest(spark, SPEC, root, wh, ScanScope.backfill())
    status = {r.file_name: (r.status, r.detail) for r in res.report.collect()}
    assert status["dt=2026-05-03/hr=00/bad.json"] == ("failed", NOT_AN_ARRAY)
    assert status["dt=2026-05-03/hr=00/object.json"] == ("failed", NOT_AN_ARRAY)
    assert status["undated/file.json"][0] == "loaded"
    assert status["dt=2026-05-03/hr=00/empty.json"][0] == "empty"
    assert "dt=2026-05-03/hr=00/empty.json" not in _log(spark, wh)  # [] yields no log row
    assert set(_log(spark, wh)) == {"undated/file.json"}
    # Failed and empty files are retried by the next run; loaded ones are skipped.
    res2 = ingest(spark, SPEC, root, wh, ScanScope.backfill())
    s2 = {r.file_name: r.status for r in res2.report.collect()}
    assert s2["undated/file.json"] == "skipped" and s2["dt=2026-05-03/hr=00/bad.json"] == "failed"
    with pytest.raises(IngestError):
        ingest(spark, SPEC, root, wh, ScanScope.backfill(), strict=True)


def test_strict_timestamps_fail_the_file(spark, tmp_root):
    root = f"{tmp_root}/landing"
    write_json(f"{root}/dt=2026-05-04/hr=00/a.json", [
        {"event_id": "a", "account_id": "a", "event_timestamp": "bad", "user_id": "u"}])
    write_json(f"{root}/dt=2026-05-04/hr=01/b.json", [
        {"event_id": "b", "account_id": "a", "event_timestamp": "2026-05-04T01:00:00Z", "user_id": "u"}])
    wh = f"{tmp_root}/wh"
    with pytest.raises(IngestError):
        ingest(spark, SPEC, root, wh, ScanScope.backfill(), strict=True)
    # the good file committed before the error was raised
    assert set(_log(spark, wh)) == {"dt=2026-05-04/hr=01/b.json"}


def test_hour_lower_bound_and_undated(spark, tmp_root):
    root = f"{tmp_root}/landing"
    rec = [{"event_id": "e", "account_id": "a", "event_timestamp": "2026-05-01T09:00:00Z", "user_id": "u"}]
    write_json(f"{root}/dt=2026-05-01/hr=09/a.json", rec)
    write_json(f"{root}/dt=2026-05-01/hr=10/b.json", rec)
    write_json(f"{root}/dt=2026-05-02/c.json", rec)          # no hr= -> hour 00
    write_json(f"{root}/misc/d.json", rec)                    # undated -> always in
    wh = f"{tmp_root}/wh"
    scope = ScanScope((None,), datetime(2026, 5, 1, 9, 30), "test")
    ingest(spark, SPEC, root, wh, scope)
    assert set(_log(spark, wh)) == {"dt=2026-05-01/hr=10/b.json", "dt=2026-05-02/c.json", "misc/d.json"}


def test_crash_before_log_leaves_invisible_orphans(spark, sample_landing, tmp_root, monkeypatch):
    wh = f"{tmp_root}/wh"
    real = C.write_batch

    def crash_on_log(df, warehouse, table, batch_id):
        if table == C.LOAD_LOG:
            raise RuntimeError("executor lost before the commit marker")
        return real(df, warehouse, table, batch_id)

    monkeypatch.setattr(C, "write_batch", crash_on_log)
    with pytest.raises(RuntimeError):
        ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill())
    monkeypatch.setattr(C, "write_batch", real)
    assert C.read_all(spark, wh, C.RAW).count() == 12          # orphans on disk
    assert C.committed(spark, wh, C.RAW).count() == 0          # but invisible
    ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill())  # retry, new batch
    assert C.committed(spark, wh, C.RAW).count() == 12
    assert _log(spark, wh) == {F_A: (3, 1), F_B: (9, 5)}


def test_split_loads_equal_one_load(spark, sample_landing, tmp_root):
    a, b = f"{tmp_root}/wh_a", f"{tmp_root}/wh_b"
    ingest(spark, SPEC, sample_landing, a, ScanScope.path("dt=2026-03-14/hr=20"))
    ingest(spark, SPEC, sample_landing, a, ScanScope.path("dt=2026-03-14/hr=21"))
    ingest(spark, SPEC, sample_landing, b, ScanScope.backfill())
    cols = ["event_id", "_filename", "_pos", "_reason"]
    def rows(wh):
        return sorted(C.committed(spark, wh, C.RAW).select(cols).collect(), key=lambda r: str(tuple(r)))
    assert rows(a) == rows(b)


def test_one_commit_for_many_and_for_large_files(spark, tmp_root):
    root = f"{tmp_root}/landing"
    event = {"account_id": "a", "event_timestamp": "2026-05-05T00:00:00Z", "user_id": "u"}
    for h in range(24):
        write_json(f"{root}/dt=2026-05-05/hr={h:02d}/f.json", [{"event_id": f"e{h}", **event}])
    write_json(f"{root}/dt=2026-05-06/hr=00/large.json", [{"event_id": f"l{n}", "pad": "x" * 2000, **event} for n in range(10_000)])
    wh = f"{tmp_root}/wh"
    res = ingest(spark, SPEC, root, wh, ScanScope.backfill())
    assert len(res.batches) == 1 and C.committed(spark, wh, C.LOAD_LOG).count() == 25
    assert C.committed(spark, wh, C.RAW).count() == 10_024
    again = ingest(spark, SPEC, root, wh, ScanScope.backfill())
    assert again.batch_id is None and {r.status for r in again.report.collect()} == {"skipped"}


def test_every_file_has_a_status_and_failures_are_tried_again(spark, tmp_root):
    root, wh = f"{tmp_root}/landing", f"{tmp_root}/wh"
    good = [{"event_id": "e", "account_id": "a", "event_timestamp": "2026-05-05T00:00:00Z", "user_id": "u"}]
    for name, body in {"good": good, "bad": "not json", "object": "{}", "none": "[]"}.items():
        write_json(f"{root}/{name}.json", body)
    first = ingest(spark, SPEC, root, wh, ScanScope.backfill(), persist_report=True)
    assert {r.file_name: r.status for r in first.report.collect()} == {
        "good.json": "loaded", "bad.json": "failed", "object.json": "failed", "none.json": "empty"}
    write_json(f"{root}/bad.json", good)
    again = retry_failed(spark, SPEC, root, wh)
    assert {r.file_name: r.status for r in again.report.collect()} == {"bad.json": "loaded", "object.json": "failed"}
    assert C.committed(spark, wh, C.LOAD_LOG).count() == 2


def test_special_characters_in_paths(spark, tmp_root):
    root = f"{tmp_root}/land ing"
    names = ["a b.json", "c%d.json", "e+f.json", "ü.json"]
    for n in names:
        write_json(f"{root}/dt=2026-05-06/hr=00/{n}", [
            {"event_id": n, "account_id": "a", "event_timestamp": "2026-05-06T00:00:00Z", "user_id": "u"}])
    wh = f"{tmp_root}/wh"
    res = ingest(spark, SPEC, root, wh, ScanScope.backfill())
    assert sorted(r.file_name for r in res.report.collect() if r.status == "loaded") == \
        sorted(f"dt=2026-05-06/hr=00/{n}" for n in names)
    assert sorted(r.event_id for r in C.committed(spark, wh, C.RAW).collect()) == sorted(names)
    again = ingest(spark, SPEC, root, wh, ScanScope.backfill())
    assert {r.status for r in again.report.collect()} == {"skipped"}


def test_persisted_report(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill(), persist_report=True)
    rep = C.committed(spark, wh, C.RUN_REPORT)
    assert sorted((r.file_name, r.status) for r in rep.collect()) == [(F_A, "loaded"), (F_B, "loaded")]


def test_run_with_only_empty_and_bad_files(spark, tmp_root):
    root = f"{tmp_root}/landing"
    write_json(f"{root}/dt=2026-05-07/hr=00/empty.json", "[]")
    write_json(f"{root}/dt=2026-05-07/hr=01/bad.json", "not json")
    wh = f"{tmp_root}/wh"
    res = ingest(spark, SPEC, root, wh, ScanScope.backfill(), persist_report=True)
    assert sorted((r.file_name, r.status) for r in res.report.collect()) == [
        ("dt=2026-05-07/hr=00/empty.json", "empty"), ("dt=2026-05-07/hr=01/bad.json", "failed")]
    assert C.committed(spark, wh, C.RAW).count() == 0
    assert C.committed(spark, wh, C.LOAD_LOG).count() == 0
    assert res.totals().first().files_loaded == 0


@pytest.mark.parametrize("strict", [False, True])
def test_a_file_is_parsed_once(spark, strict):
    files = spark.createDataFrame([("a", "[1,2]"), ("b", "x"), ("c", "[]"), ("d", None)], "_filename string, value string")
    records = WholeFiles(EVENTS["page_views"], lambda _: files, strict).records(files)
    assert sorted((r._filename, r._pos) for r in records.collect()) == [("a", 0), ("a", 1)]
    assert records._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_a_key_is_looked_up_once(spark):
    spec = EVENTS["page_views"]
    records = spark.sql("SELECT 'f' _filename, 0 _pos, parse_json(concat('{\"a\":', id, '}')) payload FROM range(2)")
    plan = raw_rows(spec, records, C.run_timestamp())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") == len({spec.key_field, spec.account_field, spec.timestamp_field, *spec.required})
