import random
import re

import pytest

from lakeloom.llm import decontaminate as D


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        own = shingles(text)
        for item_id, item in items:
            s = shingles(item)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((doc_id, item_id, len(s & own), len(s)))
    return out


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.mark.parametrize("smallest", [5, 14, 200])
def test_items_of_any_size_in_texts_of_any_size(spark, smallest):
    rng = random.Random(smallest)
    items = [(i, " ".join(words(rng, rng.randint(smallest, 4 * smallest)))) for i in range(12)]
    docs = []
    for i in range(60):
        body = words(rng, rng.choice([0, 3, 30, 3000]))
        item = items[i % 12][1].split()
        if i % 3:
            for _ in range(i % 3 - 1):  # a changed word or none
                item[rng.randrange(len(item))] = "other"
            at = rng.randint(0, len(body))
            body = body[:at] + item + body[at:]
        docs.append((i, " ".join(body)))
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got.collect()} == brute(docs, items)


def test_bins_follow_the_size_of_the_smallest_item():
    assert D.extra_bits(10) >= 1 and D.extra_bits(1) > D.extra_bits(10) > D.extra_bits(400)
    assert [D.needed(n) for n in (1, 5, 10, 11)] == [1, 4, 8, 9]


def test_nulls_repeats_clashes_and_empty_tables(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame(
        [(1, f"a {item} b", 7, "x"), (1, f"a {item} b", 7, "x"), (None, item.upper(), 8, "x"), (2, None, 9, None), (3, "", 1, "x"), (4, "one two three four", 2, "x"), (5, "word " * 100_000 + item, 3, "x")],
        "doc_id long, text string, item_id int, key string")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (1, "entirely different words in this one here", 0), (2, None, 0), (3, "too short", 0), (None, item, 0)], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id, r.containment) for r in D.report(docs, bench).collect()), key=str)
    assert got == sorted([(d, i, 1.0) for d in (1, 1, None, 5) for i in (1, None)], key=str)
    kept = D.keep(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.report(docs.where("false"), bench).collect() == [] and D.report(docs, bench.where("item_id = 3")).collect() == []
    assert D.keep(docs, bench.where("false")).count() == 7


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 20))) for i in range(4)]
    docs = [(i, " ".join(words(rng, 50)) + " " + items[i % 4][1]) for i in range(8)] + [(9, "clean words only in this text of mine")]
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in D.report(d, b).collect()} == brute(docs, items)
    assert [r.doc_id for r in D.keep(d, b).collect()] == [9]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_items_of_fewer_than_five_words(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(8)
    items = [(1, "W1!"), (2, "w2 w3"), (3, "w4, W5 w6"), (4, "w1 w2 w1 w2"), (5, ""), (6, None), (7, "w1 w1"), (8, "..."), (None, "w3")]
    docs = [(i, " ".join(f"w{rng.randrange(8)}" for _ in range(rng.choice([0, 1, 2, 4, 5, 30])))) for i in range(200)]
    docs += [(200, None), (200, "w2  W3."), (None, "x w4 w5 w6 x"), (201, "w4 w5 x w6"), (202, "none of them")]
    schema = "item_id long, text string"
    d, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, schema)

    def runs(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def holds(text, item):
        w, v = runs(text), runs(item)
        return bool(v) and any(w[i:i + len(v)] == v for i in range(len(w) - len(v) + 1))

    want = {(a, b) for a, text in docs for b, item in items if holds(text, item)}
    got = D.report(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {(r.shared, r.item_shingles, r.containment) for r in got} == {(1, 1, 1.0)}
    clean = [t or "" for _, t in docs if not any(holds(t, item) for _, item in items)]
    assert sorted(r.text or "" for r in D.keep(d, bench).collect()) == sorted(clean)
    longer = (9, "one two three four five six seven")
    both = D.report(spark.createDataFrame([(1, longer[1] + " w1"), (2, longer[1])], "doc_id long, text string"), spark.createDataFrame([*items, longer], schema))
    assert sorted((r.doc_id, r.item_id, r.item_shingles) for r in both.collect()) == [(1, 1, 1), (1, 9, 3), (2, 9, 3)]
