import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lakeloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, ref int, depth int, digest string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        inner = {q[:-1] for q in members if q}
        words = lambda q: len(re.findall(P.WORD, q[-1][1])) if q else 0
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(1 for q in members if q and q[:-1] == p),
                    sum(1 for q in below if q not in inner), sum((len(members[q]) - 1) * words(q) for q in below),
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, partitions=3):
    return sorted((tuple(r) for r in P.trie(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).select(*COLUMNS).collect()), key=str)


def turn(c, t, role="user", text="a b"):
    return (c, t, role, text, 1, 2, "clash")


def test_trie_equals_lists(spark):
    rng = random.Random(5)
    rows = [turn(c, t, "user" if t % 2 == 0 else "bot", rng.choice(["a", "b  c\td", "", "é\x0bx"])) for c in range(70) for t in range(rng.randrange(1, 7))]
    rng.shuffle(rows)
    assert got(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [turn(None, 0), turn(3, None), turn(3, 0, None, None), turn(3, 0, None, None), turn(4, 1, "user", "x" * 300_000), turn(4, 1, "bot", "x y"),
            turn(41, 0), turn(45, 0), turn(0, 5, "", "z"), turn(60, 1), *[turn(10**15 + 7, t, text=str(t)) for t in range(5)]]
    assert got(spark, rows, 4) == expected(rows)
    assert got(spark, []) == []


def test_many_equal_conversations_and_a_long_one_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS_AT_ONCE", 3)
    rows = [turn(c, t, text=f"t{t}") for c in range(300) for t in range(2)] + [turn(7, t, text=f"w {t}") for t in range(2, 900)]
    assert [r for r in got(spark, rows, 6) if r[1] < 5] == [r for r in expected(rows[:600] + rows[600:]) if r[1] < 5]


@pytest.mark.parametrize("cut", range(4))
def test_products_compose(cut):
    maps = [P.element(hashlib.sha256(bytes([i])).hexdigest()) for i in range(4)]

    def product(fs):
        f = (1, 0)
        for g in fs:
            f = P.then(f, g)
        return f
    assert product(maps) == P.then(product(maps[:cut]), product(maps[cut:])) != product(maps[::-1])
    assert P.unpacked(P.packed(product(maps))) == product(maps)
