"""The stream to staging survives a crash at any point; files are neither lost nor loaded twice."""

import pytest

from conftest import write_json
from lakeloom.config import EVENTS
from lakeloom.operators import commit as C
from lakeloom.operators import snapshot as S
from lakeloom.plans import staging as STG
from lakeloom.plans.ingest import ingest
from lakeloom.sources.landing import ScanScope
from lakeloom.streaming.file_arrival import failed_files, run_available_now

SPEC = EVENTS["page_views"]


def staged(df):
    return sorted((r.event_id, r._filename, r._pos) for r in df.select("event_id", "_filename", "_pos").collect())


@pytest.mark.parametrize("broken", ["_commit", "latest_by_key"])
def test_killed_between_data_and_commit(spark, sample_landing, tmp_root, monkeypatch, broken):
    wh, ckpt, snap = f"{tmp_root}/wh", f"{tmp_root}/ckpt", f"{tmp_root}/snap"
    real, calls = getattr(S, broken), []

    def dies(*a, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*a, **kw)
    monkeypatch.setattr(S, broken, dies)
    with pytest.raises(Exception, match="killed"):
        run_available_now(spark, SPEC, sample_landing, wh, ckpt, max_files_per_trigger=1, staging=snap)
    run_available_now(spark, SPEC, sample_landing, wh, ckpt, max_files_per_trigger=1, staging=snap)
    raw = C.committed(spark, wh, C.RAW)
    assert raw.count() == 12
    assert staged(S.current(spark, snap)) == staged(STG.stg_events(raw, SPEC))
    commits = S.commits(spark, snap).where("stream is not null").collect()
    assert len({(r.stream, r.epoch) for r in commits}) == len(commits)


def test_a_corrected_file_is_loaded_by_the_command_line(spark, tmp_root):
    from lakeloom.cli import main
    landing, wh = f"{tmp_root}/landing", f"{tmp_root}/wh"
    bad = write_json(f"{landing}/dt=2026-03-14/hr=20/bad.json", "[{")
    write_json(f"{landing}/dt=2026-03-14/hr=21/none.json", "")
    run = ["stream", "--landing", landing, "--warehouse", wh, "--checkpoint", f"{tmp_root}/ckpt", "--available-now", "--staging", f"{tmp_root}/snap"]
    assert main(run) == 1
    assert {r.file_name.rsplit("/")[-1] for r in failed_files(spark, wh).collect()} == {"bad.json", "none.json"}
    write_json(bad, [{"event_id": "e", "account_id": "a", "event_timestamp": "2026-05-01T11:00:00Z", "user_id": "u"}])
    assert main(run) == 1  # the one of 0 bytes is still there
    assert C.committed(spark, wh, C.RAW).count() == 1 and S.current(spark, f"{tmp_root}/snap").count() == 1
    write_json(f"{landing}/dt=2026-03-14/hr=21/none.json", "[{}]")
    assert main(run) == 0
    assert C.committed(spark, wh, C.RAW).count() == 2


def test_one_folder_however_it_is_written(spark, sample_landing, tmp_root):
    wh = f"{tmp_root}/wh"
    plain = "/" + sample_landing.removeprefix("file:").lstrip("/")
    ingest(spark, SPEC, f"file://{plain}", wh, ScanScope.backfill())
    for root in (plain, f"file:{plain}", f"file://{plain}/", plain.replace("/landing", "//landing")):
        report = ingest(spark, SPEC, root, wh, ScanScope.backfill()).report
        assert {r.status for r in report.collect()} == {"skipped"} and report.count() == 2
    assert C.committed(spark, wh, C.RAW).count() == 12


def test_many_files_are_joined_not_named(spark, sample_landing, tmp_root, monkeypatch):
    from lakeloom.sources import landing
    monkeypatch.setattr(landing, "NAMED_FILES", 1)
    report = ingest(spark, SPEC, sample_landing, f"{tmp_root}/wh", ScanScope.backfill()).report
    assert {r.status for r in report.collect()} == {"loaded"} and C.committed(spark, f"{tmp_root}/wh", C.RAW).count() == 12


def test_staging_opens_only_new_batches(spark, sample_landing, tmp_root):
    wh, snap = f"{tmp_root}/wh", f"{tmp_root}/snap"
    ingest(spark, SPEC, sample_landing, wh, ScanScope.path("dt=2026-03-14/hr=20"))
    first = staged(STG.stage_events(spark, SPEC, wh, snap))
    for f in C.read_all(spark, wh, C.RAW).inputFiles():  # no reader gets through the first batch any more
        with open("/" + f.removeprefix("file:").lstrip("/"), "wb") as broken:
            broken.write(b"none")
    ingest(spark, SPEC, sample_landing, wh, ScanScope.path("dt=2026-03-14/hr=21"))
    assert len(staged(STG.stage_events(spark, SPEC, wh, snap))) > len(first)
