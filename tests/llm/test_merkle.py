import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, digest string, size int, g int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def expected(rows):
    """The definition, by lists: every level of every source, then of the sources."""
    def paths(nodes):
        where, up = [[] for _ in nodes], [(d, [i]) for i, d in enumerate(nodes)]
        while len(up) > 1:
            runs = [up[k:k + 16] for k in range(0, len(up), 16)]
            for run in runs:
                for j, (_, below) in enumerate(run):
                    for i in below:
                        where[i].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1:]]))
            up = [(H(*(d for d, _ in run)), [i for _, b in run for i in b]) for run in runs]
        return up[0][0], where

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by = {}
    for i, text, lang, source, n, *_ in rows:
        hit = zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
        by.setdefault(source, []).append((i, leaf(i, text, lang, source, n), leaf(i, text.translate(lower) if hit and text is not None else text, lang, source, n)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    sub = {s: paths([d for _, d, _ in by[s]]) for s in order}
    root, tops = paths([sub[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (i, d, checked), path in zip(by[s], sub[s][1]):
            node = checked
            for left, right in path + top:
                node = H(*left, node, *right)
            out.append((i, d, sub[s][0], root, H(*(x for left, right in path + top for x in left + right)), node, node == root))
    return out


def got(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return [tuple(r) for r in M.manifest(docs, M.lower_case_every_fifth(docs)).collect()]


def row(i, source, text="Some Text", lang="en", n=9):
    return (i, text, lang, source, n, "clash", 1, 2)


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17], [257, 1, 15, 4097]])
def test_every_proof_equals_the_definition(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [row(rng.randrange(10**6), f"s{k}", text=f"Text {rng.random()} ÄB", n=None if j % 7 == 0 else j) for k, n in enumerate(sizes) for j in range(n)]
    assert sorted(got(spark, rows), key=str) == sorted(expected(rows), key=str)


def test_more_sources_than_one_run_nulls_ties_and_long_texts(spark):
    rows = [row(i, f"{i:x}", text="A" * (i * 10_000)) for i in range(20)] + [row(None, None), row(None, None, text=None, lang=None), row(5, None, text=""), row(5, "é"), row(5, "é"), row(-3, "")]
    assert sorted(got(spark, rows, 5), key=str) == sorted(expected(rows), key=str)


def test_empty_table_and_untouched_texts(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([row(i, "s") for i in range(40)], SCHEMA)
    assert M.manifest(docs).where(~F.col("verified")).count() == 0


def test_a_small_block_gives_the_same_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "DIGITS", 1)
    rows = [row(i, f"s{i % 2}") for i in range(600)]
    assert sorted(got(spark, rows), key=str) == sorted(expected(rows), key=str)
