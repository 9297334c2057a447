import zlib

import numpy as np

from lakeloom.llm import quality as Q


def test_features_do_not_depend_on_neighbours_or_passes():
    texts = ["One two. Three", "", None, "AA!! BB!!\nAA!! BB!!", "x x x x", "é" * 10, " \n ", "a" * 1_200_000, "1 2"]
    together = Q.features(texts)
    alone = np.concatenate([Q.features([t]) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()
    at = {n: i for i, n in enumerate(Q.FEATURES)}
    assert together[1].sum() == together[2].sum() == 0
    assert together[3, at["shouted"]] == 1 and together[3, at["tagged"]] == 1
    assert np.isclose(together[3, at["repeated_lines"]] ** 2, 0.5)
    assert np.isclose(together[4, at["adjacent"]] ** 2, 0.75)


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(1)
    x0, x1 = rng.normal(0, 2, (400, 3)), rng.normal(1, 1, (900, 3))
    sums = [(len(x), x.sum(0), x.T @ x) for x in (x0, x1)]
    m = Q.Discriminant.from_sums(*sums)
    point = rng.normal(0, 1, (5, 3))
    odds = np.log(900 / 400)
    for mean, factor, sign in zip(m.means, m.factors, (-1, 1)):
        cov = factor @ factor.T
        d = point - mean
        odds = odds + sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(m.score(point), 1 / (1 + np.exp(-odds)))


def test_one_class_or_none():
    none = (0, np.zeros(2), np.zeros((2, 2)))
    one = (3, np.ones(2), np.eye(2))
    assert list(Q.Discriminant.from_sums(none, none).score(np.zeros((1, 2)))) == [0.5]
    assert list(Q.Discriminant.from_sums(none, one).score(np.zeros((1, 2)))) == [1.0]


def test_tables_with_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame(
        [(1, "fine words here", 0.1), (1, "fine words here", 0.1), (2, None, None), (None, "", 0.2), (3, "BAD!! BAD!! BAD!!", 0.3)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    scores, model = Q.classify(docs, labels)
    rows = scores.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert Q.keep(docs, model).schema == docs.schema
    empty, _ = Q.classify(docs.where("false"), labels.where("false"))
    assert empty.collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(4000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scores, _ = Q.classify(docs, labels)
    own = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in scores.collect() if r.doc_id in own and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([r.predicted == own[r.doc_id] for r in held]) > 0.98
