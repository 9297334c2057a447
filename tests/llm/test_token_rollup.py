import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm.token_rollup import RollupStore

SCHEMA = "source string, lang string, tokenizer string, op string, n_tokens long, old_n_tokens long, documents int"


def changes(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in store.totals().collect()}


def test_batches_are_applied_once_and_sum_up(spark):
    store, rng, want = RollupStore(spark), random.Random(1), {}
    for b in range(4):
        rows = [(rng.choice(["a", "a", "b", None]), rng.choice(["en", None]), "v1", rng.choice(["insert", "delete", "revise"]), rng.choice([None, 3, 8]), rng.choice([None, 2])) for _ in range(40)]
        for s, l, t, op, n, old in rows:
            d, k = want.get((s, l, t), (0, 0))
            n, old = n or 0, old or 0
            sign = {"insert": 1, "delete": -1, "revise": 0}[op]
            want[s, l, t] = (d + sign, k + (n - old if op == "revise" else sign * n))
        assert store.commit(f"b{b}", changes(spark, rows))
        assert not store.commit(f"b{b}", changes(spark, rows))
    want = {k: v for k, v in want.items() if v != (0, 0)}
    assert totals(store) == want
    store.compact()
    store.compact()
    assert totals(store) == want and store.commits().count() == 1
    assert not store.commit("b0", changes(spark, [("a", "en", "v1", "insert", 1, None)]))
    assert store.commit("b9", changes(spark, [("new", "en", "v1", "insert", 5, None)]))
    assert totals(store) == want | {("new", "en", "v1"): (1, 5)}


def test_a_failed_commit_applies_nothing(spark):
    store = RollupStore(spark)
    for op in ("upsert", None):
        with pytest.raises(Exception, match="unknown operation"):
            store.commit("b", changes(spark, [("a", "en", "v", "insert", 1, None), ("a", "en", "v", op, 1, None)]))
    assert not store.has("b") and totals(store) == {}
    assert store.commit("b", changes(spark, [("a", "en", "v", "insert", 1, None)])) and totals(store) == {("a", "en", "v"): (1, 1)}


def test_two_attempts_of_one_batch(spark):
    store = RollupStore(spark)
    rows = changes(spark, [("a", "en", "v", "insert", 1, None)])
    assert store.commit("b", rows)
    store.has = lambda batch_id: False  # the other attempt looked before the first committed
    assert store.commit("b", rows) and totals(store) == {("a", "en", "v"): (1, 1)}


def test_empty_batch_and_groups_that_cancel(spark):
    store = RollupStore(spark)
    assert totals(store) == {}
    assert store.commit("empty", changes(spark, [("a", "en", "v", "insert", 1, None)]).where(F.lit(False))) and store.has("empty")
    store.commit("b", changes(spark, [("a", "en", "v", "insert", 4, None), ("a", "en", "v", "delete", 4, None)]))
    assert totals(store) == {}
