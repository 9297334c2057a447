"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics (log and square-root
scales). They are rates, so a very long text is judged like a short one. Each
class gets its mean and a shrinkage covariance: ``(1 - a) * S + a * pooled``,
then ``(1 - b) * that + b * mean variance * I``. The score is the logistic
function of the difference of the two log densities (Mahalanobis distance and
log determinant, from Cholesky factors that are computed once) plus the log odds
of the classes.

Labels are learned from all labelled training rows: counts, sums and products of
the features are additive, so Spark sums them and the driver gets one row per
class.

Defined cases: a null or empty text has all rates 0 and is scored as such. With
only one class, or none, the score is that class's share (0.5 without labels).
A doc_id with several labels counts once for each label row; null labels and
null ids teach nothing. Repeated documents are scored each; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import char_class, code_points, crc32_of_id, mix64, passes, prepare_workers, stored

SHRINK_TO_POOLED = 0.1
SHRINK_TO_SPHERE = 0.02
KEEP_FROM = 0.7
#: A word counts as repeated if it equals one of so many words before it.
NEAR_WORDS = 4

FEATURES = ("letters", "upper", "digits", "spaces", "lines", "symbols", "marks", "word_length", "adjacent", "nearby",
            "shouted", "tagged", "repeated_lines")


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[ends] - total[starts]).astype(float)


def _hash_runs(cps: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every run of ``member`` positions."""
    edge = np.diff(np.concatenate([[0], member.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(a):
        return a, b, np.zeros(0, np.uint64)
    at = np.flatnonzero(member)
    place = (at - np.repeat(a, b - a)).astype(np.uint64)
    mixed = mix64(cps[at].astype(np.uint64) + (place << np.uint64(21)) + np.uint64(1))
    return a, b, np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(b - a)[:-1]]))


def _features(texts: list[str]) -> np.ndarray:
    cps, starts, ends = code_points(texts)
    n = np.maximum(ends - starts - 2, 1).astype(float)
    letter, space = char_class("letter")[cps], char_class("space")[cps]
    digit, upper = char_class("digit")[cps], char_class("upper")[cps]
    mark = np.isin(cps, np.frombuffer(".,;:'\"?-()".encode("utf-32-le"), np.uint32))
    symbol = ~(letter | space | digit | mark)
    newline = cps == 10
    a, b, word = _hash_runs(cps, ~space)
    first, last = np.searchsorted(a, starts), np.searchsorted(a, ends)
    words = np.maximum(last - first, 1).astype(float)
    doc = np.repeat(np.arange(len(texts)), last - first)
    near = np.zeros(len(word), bool)
    adjacent = near.copy()
    for lag in range(1, NEAR_WORDS + 1):
        same = (word[lag:] == word[:-lag]) & (doc[lag:] == doc[:-lag])
        near[lag:] |= same
        if lag == 1:
            adjacent[1:] |= same
    sum_of = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    cu, cl, cs = sum_of(upper), sum_of(letter), sum_of(symbol)
    letters_in, uppers_in = cl[b] - cl[a], cu[b] - cu[a]
    shouted = (uppers_in == letters_in) & (letters_in > 1)
    tagged = cs[b] > cs[a]
    inside = np.ones(len(cps), bool)
    inside[starts] = inside[ends - 1] = False
    la, _, line = _hash_runs(cps, inside & ~newline)
    owner = np.searchsorted(starts, la, "right") - 1
    order = np.lexsort((line, owner))
    again = np.zeros(len(line), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    lines = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    repeated = np.bincount(owner[order][again], minlength=len(texts)) / lines
    rate = lambda mask: _sums(mask, starts, ends) / n
    per_word = lambda mask: _sums(mask, first, last) / words
    spaces = np.clip(rate(space) - 2 / n, 0, 1)
    return np.stack([
        np.sqrt(rate(letter)), np.sqrt(rate(upper)), np.sqrt(rate(digit)), np.sqrt(spaces), np.sqrt(rate(newline)),
        np.sqrt(rate(symbol)), np.sqrt(rate(mark)), np.log1p(per_word(b - a)), np.sqrt(per_word(adjacent)),
        np.sqrt(per_word(near)), np.sqrt(per_word(shouted)), np.sqrt(per_word(tagged)), np.sqrt(repeated)], axis=1)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES per text."""
    parts = [_features([t or "" for t in texts[a:b]]) for a, b in passes(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors; ``share`` is class 1's."""

    share: float
    means: list[np.ndarray]
    factors: list[np.ndarray]

    @staticmethod
    def from_sums(zero: tuple, one: tuple) -> Discriminant:
        """From (rows, sum of x, sum of x xT) of each class."""
        n = [zero[0], one[0]]
        share = n[1] / sum(n) if sum(n) else 0.5
        if min(n) == 0:
            return Discriminant(share, [], [])
        means = [np.asarray(s, float) / k for k, s, _ in (zero, one)]
        scatter = [np.asarray(q, float) - k * np.outer(m, m) for (k, _, q), m in zip((zero, one), means)]
        pooled = sum(scatter) / sum(n)
        factors = []
        for k, s in zip(n, scatter):
            cov = (1 - SHRINK_TO_POOLED) * s / k + SHRINK_TO_POOLED * pooled
            cov = (1 - SHRINK_TO_SPHERE) * cov + SHRINK_TO_SPHERE * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
            factors.append(np.linalg.cholesky(cov))
        return Discriminant(share, means, factors)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        log_density = []
        for mean, factor in zip(self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            log_density.append(-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        odds = log_density[1] - log_density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


STATISTICS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the feature vector of every whole text."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_pylist())
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=STATISTICS.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STATISTICS)


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """Sums over all labelled rows of (doc_id, x) joined with (doc_id, quality)."""
    d = len(FEATURES)
    rows = vectors.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("quality").agg(
        F.count("*").alias("n"),
        *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)),
        *(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs)).collect()
    by = {r["quality"]: r for r in sums}

    def of(label: int) -> tuple:
        if (r := by.get(label)) is None:
            return 0, np.zeros(d), np.zeros((d, d))
        square = np.zeros((d, d))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"q{i}_{j}"]
        return r["n"], np.array([r[f"s{i}"] for i in range(d)]), square

    return Discriminant.from_sums(of(0), of(1))


def training_labels(labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & (F.pmod(crc32_of_id("doc_id"), F.lit(folds)) != held_out))


def score(vectors: DataFrame, model: Discriminant, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, score and predicted for every row of ``statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= keep_from).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    """Scores of all documents by a model of the training labels; the statistics
    are computed once and kept in the shared folder."""
    vectors = stored(statistics(docs), "quality")
    model = fit(vectors, training_labels(labels))
    return score(vectors, model), model


def keep(docs: DataFrame, model: Discriminant, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that score at least ``keep_from``, with the columns of ``docs``."""
    prepare_workers(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(at).to_pylist()))
            yield batch.filter(pa.array(s >= keep_from, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
