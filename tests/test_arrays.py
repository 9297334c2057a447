"""Arrays read by byte ranges give what parsing whole files gives."""

import random

import pytest

from conftest import write_json
from lakeloom.config import EVENTS
from lakeloom.functions.paths import plain_uri
from lakeloom.operators import commit as C
from lakeloom.plans.ingest import WholeFiles, ingest
from lakeloom.sources.arrays import SplitArrays, groups, read_fragments
from lakeloom.sources.landing import ScanScope, list_files, read_contents

SPEC = EVENTS["page_views"]

TEXTS = {
    "plain": '[{"a":1},{"b":{"c":[1,{"d":2}]}},{}]', "empty": "[]", "blank_empty": " [ \n ] ", "scalars": "[1, null, [2,3], \"x\"]",
    "mixed": '[1,{"a":2},"}",{"b":"]}"},[{"c":3}], 7 ]', "strings": '[{"a":"}{\\"}]["},{"b":"\\\\"},{"c":"\\\\\\"}"},{"d":"é}"}]',
    "spaces": ' \n[ {"a" : 1 } \n, {"b":2}\t]\n', "object": '{"a":1}', "object_list": '{"a":[{"b":1}]}', "text": "hello", "open": '[{"a":1}',
    "open_string": '[{"a":"x}]', "two": '[{"a":1}],[{"b":2}]', "two_scalars": '[1],[2,{"a":1}]', "no_comma": '[{"a":1}{"b":2}]', "comma_end": '[{"a":1},]',
    "comma_start": '[,{"a":1}]', "two_commas": '[{"a":1},,{"b":2}]', "after": '[{"a":1}]}', "after_text": '[{"a":1}] x', "early": '[{"a":1}]]', "bad_inner": '[{"a":1},{b}]',
    "long": "[" + ",".join('{"n":%d,"t":"%s"}' % (i, "y}" * (i % 40)) for i in range(15)) + "]",
}
# Text behind the array: a whole-file parse stops at the bracket and takes what it has; here the file fails.
SURPLUS = ("two", "two_scalars", "after", "after_text", "early")


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 64 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _sources(spark, root):
    scope = ScanScope.backfill()
    return (WholeFiles(SPEC, lambda f: read_contents(spark, root, scope, f)), SplitArrays(SPEC, lambda f: read_fragments(spark, root, scope, f)))


def _same(spark, root):
    files = list_files(spark, root, ScanScope.backfill()).select("path", "_filename")
    whole, split = _sources(spark, root)
    rows = lambda s: sorted((r._filename, r._pos, r.p) for r in s.records(files).selectExpr("_filename", "_pos", "to_json(payload) p").collect())
    errors = lambda s: sorted(tuple(r) for r in s.errors(files).collect())
    assert rows(split) == rows(whole)
    assert errors(split) == errors(whole)
    return rows(split)


def test_every_shape_of_file(spark, tmp_root, small_ranges):
    for name, text in TEXTS.items():
        write_json(f"{tmp_root}/{'surplus' if name in SURPLUS else 'in'}/dt=2026-01-01/{name}.json", text)
    assert len({f for f, *_ in _same(spark, f"{tmp_root}/in")}) == 6
    _, split = _sources(spark, f"{tmp_root}/surplus")
    files = list_files(spark, f"{tmp_root}/surplus", ScanScope.backfill()).select("path", "_filename")
    assert split.records(files).isEmpty() and split.errors(files).where("_file_error is not null").count() == len(SURPLUS)


def test_random_arrays(spark, tmp_root, small_ranges):
    import json
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 2:
            return "".join(rng.choice('ab}{][",\\é \n') for _ in range(rng.randrange(30)))
        if kind < 4:
            return rng.choice([1, 2.5, None, True])
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice('a}"k'): value(depth - 1) for _ in range(rng.randrange(4))}
    for i in range(5):
        write_json(f"{tmp_root}/in/f{i}.json", json.dumps([value(3) for _ in range(rng.randrange(12))], indent=rng.choice([None, 1]), ensure_ascii=bool(i % 2)))
    assert _same(spark, f"{tmp_root}/in")


def test_ingest_by_ranges_equals_ingest_whole(spark, sample_landing, tmp_root, small_ranges):
    out = []
    for split in (False, True):
        wh = f"{tmp_root}/wh{split}"
        report = ingest(spark, SPEC, sample_landing, wh, ScanScope.backfill(), split_arrays=split).report
        raw = C.committed(spark, wh, C.RAW).selectExpr("event_id", "_filename", "_pos", "_reason", "to_json(payload)")
        out.append((sorted(map(tuple, report.collect())), sorted(map(str, raw.collect()))))
    assert out[0] == out[1] and len(out[0][1]) == 12


def test_plain_uri(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("file:///a/b",), ("file:/a/b",), ("hdfs://nn/a",)], "p string").select(plain_uri(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["file:/a/b", "file:/a/b", "hdfs://nn/a"]


def test_the_texts_are_read_twice_whatever_the_number_of_sums(spark, tmp_root):
    """Once to mark the fragments, once to join them; sums over the texts themselves would double the work for each."""
    write_json(f"{tmp_root}/in/dt=2026-01-01/f.json", TEXTS["long"])
    files = list_files(spark, f"{tmp_root}/in", ScanScope.backfill()).select("path", "_filename")
    read = read_fragments(spark, f"{tmp_root}/in", ScanScope.backfill(), files)
    plan = groups(read)._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "Relation [" in line and "value#" in line]
    assert len(texts) == 1 and plan.count("aggregate(") == 0  # the marks are made by then
