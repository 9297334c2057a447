"""Two runs over one scope at the same time load its files once."""

import threading
import time

import pytest
from conftest import FILE_A, FILE_B
from pyspark.sql import functions as F

from lakeloom.config import EVENTS
from lakeloom.operators import commit as C
from lakeloom.plans.ingest import ingest
from lakeloom.sources.landing import ScanScope

SPEC = EVENTS["page_views"]


def _load(spark, root, wh, **kw):
    return ingest(spark, SPEC, root, wh, ScanScope.backfill(), **kw)


def test_two_runs_at_once_load_each_file_once(spark, sample_landing, tmp_root):
    wh, results, faults = f"{tmp_root}/wh", [], []

    def run():
        try:
            results.append(_load(spark, sample_landing, wh))
        except Exception as e:  # noqa: BLE001 - shown by the assertion below
            faults.append(e)

    runs = [threading.Thread(target=run) for _ in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert not faults
    assert C.committed(spark, wh, C.RAW).count() == len(FILE_A) + len(FILE_B)
    assert C.load_log(spark, wh).count() == 2
    assert sorted(r.report.where(F.col("status") == "skipped").count() for r in results) == [0, 2]


def test_a_held_warehouse_is_waited_for(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    with C.claim(spark, wh):
        with pytest.raises(C.Claimed):
            _load(spark, sample_landing, wh, wait=0.1)
        assert _load(spark, sample_landing, wh, dry_run=True).report.count() == 2  # writes nothing, needs no claim
    assert _load(spark, sample_landing, wh).totals().first().files_loaded == 2


def test_a_failed_run_gives_its_claim_back(spark, sample_landing, tmp_root, monkeypatch):
    wh, write = f"{tmp_root}/wh", C.write_batch

    def fails(df, warehouse, table, batch_id):
        if table == C.LOAD_LOG:
            raise RuntimeError("lost")
        write(df, warehouse, table, batch_id)

    monkeypatch.setattr(C, "write_batch", fails)
    with pytest.raises(RuntimeError, match="lost"):
        _load(spark, sample_landing, wh)
    monkeypatch.setattr(C, "write_batch", write)
    assert _load(spark, sample_landing, wh, wait=0).totals().first().files_loaded == 2


def test_a_claim_left_behind_is_put_aside_and_a_living_one_is_not(spark, sample_landing, tmp_root, monkeypatch):
    wh = f"{tmp_root}/wh"
    assert C._ClaimFile(spark, wh).made()  # its run died
    monkeypatch.setattr(C, "LEFT_BEHIND", 1.0)
    monkeypatch.setattr(C, "SIGN_OF_LIFE", 0.1)
    assert _load(spark, sample_landing, wh, wait=30).totals().first().files_loaded == 2
    with C.claim(spark, wh):
        time.sleep(1.5)  # longer than LEFT_BEHIND, but its holder shows signs of life
        with pytest.raises(C.Claimed):
            _load(spark, sample_landing, wh, wait=0.1)
