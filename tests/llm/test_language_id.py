import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"
EN = "the cat and the dog with the other thing is that they think"
DE = "der hund und die katze sind nicht über das große haus gegangen"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang, "clash") for i, (t, lang) in enumerate([(EN, "en"), (DE, "de")] * 20)]
    return L.fit(spark.createDataFrame(rows + [(99, EN, None, None), (None, None, "en", None)], SCHEMA))


def test_masks_return_all_languages_of_a_trigram(model):
    assert model.languages == ["de", "en"]
    counts, n = model.counts([EN, DE, "", None])
    assert counts[0, 1] > counts[0, 0] and counts[1, 0] > counts[1, 1]
    assert list(n[2:]) == [0, 0]


def test_more_languages_than_one_mask_byte():
    letters = "abcdefghijklmnopq"
    profiles = {f"l{c}": np.unique(L.trigrams([c * 5])[0]).astype(np.int64).tolist() for c in letters}
    found, score, _ = L.LanguageFilter.build(profiles).predict([c * 9 for c in letters])
    assert found == [f"l{c}" for c in letters] and (score > 0.9).all()


def test_edge_texts(model):
    long = EN * 40_000
    langs, score, coverage = model.predict([None, "", "123 !?", "中文", "THE DOG AND THE CAT", long])
    assert langs[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0]
    assert langs[3] == "de" and score[3] == 0 and coverage[3] == 0  # a tie: the alphabetically first
    assert langs[4:] == ["en", "en"] and 0.5 < score[5] <= 1


def test_predict_keeps_rows_and_keep_keeps_columns(spark, model):
    rows = [(1, EN, "xx", "a"), (1, EN, "xx", "a"), (None, DE, None, None), (2, None, "en", "b"), (3, "中文中文", "zh", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()), key=str)
    assert got == sorted([(1, "en"), (1, "en"), (None, "de"), (2, "und"), (3, "de")], key=str)
    kept = L.keep(docs, model)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:3], key=str)
    assert L.predict(docs.where("false"), model).collect() == [] and L.keep(docs.where("false"), model).count() == 0


def test_without_labels(spark):
    empty = L.fit(spark.createDataFrame([], SCHEMA))
    assert empty.predict([EN])[0] == ["und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert docs.where(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0")).count() == docs.count() - L.training_rows(docs).count()
    model = L.fit(L.training_rows(docs))
    own = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in L.predict(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == own[r.doc_id] for r in held]) > 0.98


def test_every_labelled_language_is_learned(spark):
    texts = {f"l{i:03}": " ".join(chr(0x4E00 + 30 * i + (7 * k + j) % 30) * 3 for j in range(6) for k in range(5)) for i in range(300)}
    rows = [(i, t, lang, "") for i, (lang, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(docs)
    assert model.languages == sorted(texts)
    assert model.predict(list(texts.values()))[0] == list(texts)
    assert L.keep(docs, model).count() == 300


def test_languages_with_many_characters_are_kept(spark):
    rng = np.random.default_rng(7)
    thin = [" ".join("".join(chr(0x4E00 + c) for c in rng.integers(0, 50, 4)) for _ in range(24)) for _ in range(900)]
    rows = [(i, t, "zh", "") for i, t in enumerate(thin)] + [(10_000 + i, EN, "en", "") for i in range(50)]
    train, test = spark.createDataFrame(rows[:600] + rows[900:], SCHEMA), spark.createDataFrame(rows[600:900], SCHEMA)
    model = L.fit(train, profile_size=1500)
    langs, _, coverage = model.predict([t for _, t, _, _ in rows[600:900]])
    assert set(langs) == {"zh"} and np.min(coverage) < L.MIN_COVERAGE
    assert L.keep(test, model).count() == 300
    odd = spark.createDataFrame([(1, "".join(chr(0xAC00 + 7 * k) for k in range(90)), None, "")], SCHEMA)
    assert L.keep(odd, model).count() == 0
