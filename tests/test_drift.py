"""Nested payload drift: every path and type, against a walk over the parsed records."""

import json
import random

from pyspark.sql import functions as F

from lakeloom.plans.monitoring import nested_drift, shape_paths

KEYS = ["a", "b", "x y", "k.k", "`q", "OBJECT", "DECIMAL(1,2)", "é", "c: STRING>"]


def _value(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return {k: _value(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(4))}
    if kind == 6:
        return [_value(rng, depth - 1)] * rng.randrange(3)
    return [None, rng.randrange(99), rng.randrange(99) + 0.5, "text, <a: b>", True][kind]


def _quoted(key):
    plain = key.isascii() and key.isidentifier()
    return key if plain else "`" + key.replace("`", "``") + "`"


def _walk(value, path, out):
    """(path, type) of everything in the record; elements of an array are alike here."""
    if isinstance(value, dict):
        out.add((path, "OBJECT"))
        for k, v in value.items():
            _walk(v, _quoted(k) if path == "$" else f"{path}.{_quoted(k)}", out)
    elif isinstance(value, list):
        out.add((path, "ARRAY"))
        _walk(value[0] if value else None, path + "[]", out)
    else:
        names = {type(None): "VOID", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", str: "STRING"}
        out.add((path, names[type(value)]))


def test_paths_as_a_walk_finds_them(spark):
    rng = random.Random(5)
    records = [{k: _value(rng, 3) for k in rng.sample(KEYS, 5)} for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string")
    shapes = df.select("i", shape_paths(F.schema_of_variant(F.parse_json("j"))).alias("p")).collect()
    assert len(shapes) == len(records)
    for row in shapes:
        want = set()
        _walk(records[row.i], "$", want)
        assert sorted((p.path, p.type) for p in row.p) == sorted(want), records[row.i]


def test_statuses_and_counts(spark):
    texts = ['{"n": 1, "d": 1, "s": "x", "o": {"p": 1}, "void": null}', '{"n": 1.5, "d": 2.5, "s": 7, "o": {"p": 2, "new": [1, null]}}',
             '{"n": 3, "d": null, "o": 5}', None, '{}', "[]"]
    raw = spark.createDataFrame([(t, 1) for t in texts], "j string, path int").select(F.parse_json("j").alias("payload"), "path")
    contract = {"n": "BIGINT", "d": "DOUBLE", "s": "STRING", "o": "OBJECT", "o.p": "BIGINT", "void": "STRING", "gone": "ARRAY"}
    got = {r.path: tuple(r)[1:] for r in nested_drift(raw, contract).collect()}
    assert got == {
        "n": ("BIGINT,DECIMAL", "DECIMAL", 3, 0, 3, "widened"),
        "d": ("BIGINT,DECIMAL", "DECIMAL", 3, 1, 3, "same"),
        "s": ("BIGINT,STRING", "VARIANT", 2, 0, 4, "breaking"),
        "o": ("BIGINT,OBJECT", "VARIANT", 3, 0, 3, "breaking"),
        "o.p": ("BIGINT", "BIGINT", 2, 0, 4, "same"),
        "o.new": ("ARRAY", "ARRAY", 1, 0, 5, "additive"),
        "o.new[]": ("BIGINT", "BIGINT", 1, 0, 5, "additive"),
        "void": ("", None, 1, 1, 5, "same"),
        "gone": ("", None, 0, 0, 6, "missing"),
        "$[]": ("", None, 1, 1, 5, "additive"),
    }
    empty = nested_drift(raw.where("false"), contract).collect()
    assert {(r.path, r.status, r.records_without) for r in empty} == {(p, "missing", 0) for p in contract}


def test_payloads_are_read_once(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.range(50).select(F.parse_json(F.to_json(F.struct("id"))).alias("payload")).write.parquet(path)
    out = nested_drift(spark.read.parquet(path), {"id": "BIGINT"})
    assert [tuple(r) for r in out.collect()] == [("id", "BIGINT", "BIGINT", 50, 0, 0, "same")]
    # The plan as it ran: up to the outer initial plan, less the scan in the subquery's initial plan.
    ran = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[:2]
    assert sum(part.count("FileScan") for part in ran) - 1 == 1
    assert any("ReusedExchange" in part for part in ran)
