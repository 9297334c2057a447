import collections
import itertools
import random
import re

import numpy as np
import pytest

from lakeloom.llm import near_dedup as N
from lakeloom.llm.components import components


def shingle_counts(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similar(a, b):
    common = sum((a & b).values())
    return bool(a) and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) - 1e-9


def brute_classes(rows):
    """Row number -> smallest row number of its class."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    counts = [shingle_counts(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] is not None and (rows[i][1] == rows[j][1] or similar(counts[i], counts[j])):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def test_signature_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 1 << 60, 400, dtype=np.uint64)
    x, y = rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    k = 4000
    sig = N.dart_signatures(np.repeat([0, 1], 400), np.tile(elements, 2), np.concatenate([x, y]), 3, k)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5
    assert (sig[2] == 0).all() and (sig[:2] != 0).all()


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    e, w = rng.integers(1, 1 << 60, 50, dtype=np.uint64), rng.uniform(0.1, 5, 50)
    alone = N.dart_signatures(np.zeros(50, int), e, w, 1)
    order = rng.permutation(50)
    again = N.dart_signatures(np.full(50, 2), e[order], w[order], 4)
    assert (alone[0] == again[2]).all()
    one = N.dart_signatures(np.array([0]), e[:1], np.array([1.0]), 1)
    assert len(set(one[0].tolist())) == N.COORDINATES  # every coordinate has a dart of its own


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300)] + [(7, 7), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {200}
    assert {got[i] for i in (300, 301, 302)} == {300} and got[7] == 7
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(1000 + i, " ".join(word() for _ in range(rng.randint(1, 120)))) for i in range(25)]
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(rng.randint(5, 80)))) for i in range(15)]
    for n, (doc_id, text) in enumerate(rows[:12]):
        words = text.split()
        for copy in range(4):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(len(changed))] = word()
            rows.append((3000 + 10 * n + copy, " ".join(changed).upper() if copy == 1 else " ".join(changed)))
    chain = [word() for _ in range(80)]  # neighbours are similar, the ends aren't
    for i in range(12):
        rows.append((4000 + i, " ".join(chain)))
        chain = chain[3:] + [word() for _ in range(3)]
    return rows + [(5000, None), (5001, None), (5002, ""), (5003, ""), (5004, "!"), (5005, "Hi"), (5006, "hi."), (1000, rows[0][1]),
                   (None, rows[1][1]), (None, "no id and no copy"), (6000, "long word " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(6).shuffle(rows)
    return spark.createDataFrame([(i, t, i, "c") for i, t in rows], "doc_id long, text string, class_id long, uid string").repartition(4).cache()


def test_classes_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    label = brute_classes(rows)
    members = collections.defaultdict(list)
    for (doc_id, _), own in zip(rows, label):
        members[own].append(doc_id)
    want = sorted((doc_id, min((m for m in members[own] if m is not None), default=None), len(members[own])) for (doc_id, _), own in zip(rows, label) if doc_id is not None)
    got = [tuple(r) for r in N.classes(docs).collect()]
    assert sorted(g for g in got if g[0] is not None) == want and len(got) == len(rows)


def test_keep_leaves_one_row_of_each_class(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = N.keep(docs)
    assert kept.schema == docs.schema and kept.count() == len(set(brute_classes(rows)))


def test_a_bucket_over_many_cells_loses_nothing(spark, monkeypatch):
    """Near copies around the limit, in cells of a few rows."""
    monkeypatch.setattr(N, "STRAYS", 3)
    monkeypatch.setattr(N, "MEMBERS", 5)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(40)] == brute_classes(rows)


def test_empty_and_linkless_tables(spark, docs):
    assert N.classes(docs.where("false")).collect() == [] and N.keep(docs.where("false")).collect() == []
    two = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, N.classes(two).collect())) == [(1, 1, 1), (2, 2, 1)]
