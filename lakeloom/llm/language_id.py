"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bitmask per position, one bit per language.
Looking an n-gram up ANDs the masks at its hashed positions, which returns all
languages whose profile holds the n-gram at once. A text is decided by the
per-language popcounts over all its n-grams, corrected for the filter's false
positives: with fill ``p`` of a language's slice and ``k`` probes, a foreign
n-gram hits with ``f = p**k``, so of ``n`` n-grams with ``h`` hits about
``(h - f*n) / (1 - f)`` are true ones.

N-grams are letter trigrams: every letter with its two neighbours, non-letters
read as a space, lower-cased. A profile is the most frequent trigrams of a
bounded sample of labelled texts (about ``sample_per_language`` whole texts and
at most ``profile_size`` trigrams per language, each at least ``PROFILE_SHARE``
of the language's trigrams). Every language that has a label is learned. Prediction
covers every whole text.

``keep`` asks for a share of a text's trigrams in the profile: ``MIN_COVERAGE``, or
less for a language that spreads its trigrams thinner. For that, a profile of one half
of the sample is tried on the other half; the language's limit is half the coverage
that ``LOW`` of those texts stay under (0 if there are none to try; a text without any
known trigram goes in any case).

Defined cases: null text or text without a letter: ``und`` with score 0. A text
with letters but without any known trigram, and ties, take the alphabetically
first of the best languages. No labelled rows at all: ``und``. Null ``lang`` or
null ids are fine. An empty table gives an empty result. Repeated rows are
predicted each. Other columns are neither read nor returned by ``predict``;
``keep`` returns the input's own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakeloom.llm.common import char_class, code_points, crc32_of_id, mix64, passes, prepare_workers, stored

SAMPLE_PER_LANGUAGE = 2000
PROFILE_SIZE = 4000
PROFILE_SHARE = 1e-4
FILTER_BITS = 18
PROBES = 3
MIN_COVERAGE = 0.2
LOW = 0.01


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams (three 21-bit code points) around each letter, and the
    start and end of each text's stretch of them."""
    cps, starts, ends = code_points([(t or "").lower() for t in texts])
    letter = char_class("letter")[cps]
    c = np.where(letter, cps, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    grams = (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1]
    return grams, np.searchsorted(at, starts), np.searchsorted(at, ends)


def _probe(grams: np.ndarray, j: int, bits: int) -> np.ndarray:
    return mix64(grams + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) >> np.uint64(64 - bits)


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter: ``masks[word][position]`` has bit ``l`` for
    language ``8 * word + l``. ``limits``: least coverage by language, if learned."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    limits: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def build(profiles: dict[str, list[int]], bits: int = FILTER_BITS) -> LanguageFilter:
        languages = sorted(profiles)
        masks = np.zeros((max(1, -(-len(languages) // 8)), 1 << bits), np.uint8)
        rate = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            grams = np.array(profiles[lang], np.int64).astype(np.uint64)
            for j in range(PROBES):
                np.bitwise_or.at(masks[i // 8], _probe(grams, j, bits), np.uint8(1 << i % 8))
            rate[i] = ((masks[i // 8] >> (i % 8)) & 1).mean() ** PROBES
        return LanguageFilter(languages, masks, rate)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits per text and language, and the trigrams per text."""
        bits = self.masks.shape[1].bit_length() - 1
        grams, starts, ends = trigrams(texts)
        n = (ends - starts).astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        at = [_probe(grams, j, bits) for j in range(PROBES)]
        for w, row in enumerate(self.masks):
            found = row[at[0]] & row[at[1]] & row[at[2]]
            for b in range(min(8, len(self.languages) - 8 * w)):
                total = np.concatenate([[0], np.cumsum((found >> b) & 1, dtype=np.int64)])
                hits[:, 8 * w + b] = total[ends] - total[starts]
        return np.clip((hits - self.false_rate * n[:, None]) / (1 - self.false_rate), 0, None), n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (best against second best, 0 to 1) and coverage (share
        of trigrams that the best language's profile holds) of each text."""
        langs: list[str] = []
        score, coverage = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in passes(texts):
            if not self.languages:
                langs += ["und"] * (b - a)
                continue
            c, n = self.counts(texts[a:b])
            best = c.argmax(1)
            top = c[np.arange(b - a), best]
            c[np.arange(b - a), best] = -1
            second = np.clip(c.max(1), 0, None) if c.shape[1] > 1 else np.zeros(b - a)
            langs += [self.languages[i] if k else "und" for i, k in zip(best, n)]
            score[a:b] = np.divide(top, top + second, out=np.zeros(b - a), where=top > 0)
            coverage[a:b] = np.minimum(1, np.divide(top, n, out=np.zeros(b - a), where=n > 0))
        return langs, score, coverage


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE,
        profile_size: int = PROFILE_SIZE) -> LanguageFilter:
    """Learn from rows (text, lang, sample key ``doc_id``) with non-null lang."""
    spark = labelled.sparkSession
    prepare_workers(spark)
    # Rows without an id are drawn by their text, equal ones of them together.
    drawn_by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = labelled.where("lang is not null and text is not null").select(
        "lang", "text", (F.pmod(drawn_by, F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw"),
        F.pmod(F.xxhash64("text", "doc_id"), F.lit(2)).cast("int").alias("half"))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return LanguageFilter.build({})
    share = spark.createDataFrame([(r["lang"], min(1.0, sample_per_language / r["count"])) for r in sizes], "lang string, share double")
    sample = stored(rows.join(F.broadcast(share), "lang").where("draw < share").select("lang", "half", "text"), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[str, int], list[str]] = {}
            for lang, half, text in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault((lang, half), []).append(text)
            for (lang, half), own in sorted(groups.items()):
                for a, b in passes(own):
                    grams, n = np.unique(trigrams(own[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array([half] * len(grams), pa.int32()), pa.array(grams.astype(np.int64)), pa.array(n)],
                        names=["lang", "half", "gram", "n"])

    counted = stored(sample.mapInArrow(count, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(
        F.sum("n").alias("n")), "language-grams")
    own = Window.partitionBy("lang")

    def learned(grams: DataFrame) -> LanguageFilter:
        each = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        top = each.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("n"), "gram")), "all": F.sum("n").over(own)}).where(
            (F.col("rank") <= profile_size) & (F.col("n") >= PROFILE_SHARE * F.col("all")))
        profiles: dict[str, list[int]] = {r["lang"]: [] for r in sizes}
        for r in top.select("lang", "gram").toLocalIterator():
            profiles[r["lang"]].append(r["gram"])
        return LanguageFilter.build(profiles)

    tried = learned(counted.where("half = 0"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(tried.languages)}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in passes(texts):
                hits, n = tried.counts(texts[a:b])
                of = hits[np.arange(b - a), [place[x] for x in langs[a:b]]]
                some = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[a:b], pa.string()).filter(pa.array(some)), pa.array(np.minimum(1, of[some] / n[some]))],
                    names=["lang", "coverage"])

    low = sample.where("half = 1").select("lang", "text").mapInArrow(cover, "lang string, coverage double").groupBy("lang").agg(
        F.percentile_approx("coverage", LOW).alias("low")).collect()  # a row per language
    model = learned(counted)
    model.limits = dict.fromkeys(model.languages, 0.0) | {r["lang"]: r["low"] / 2 for r in low}
    return model


PREDICTION = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())])


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, coverage."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, coverage = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(coverage)],
                names=PREDICTION.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTION)


def keep(docs: DataFrame, model: LanguageFilter, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The documents in a learned language, with the columns of ``docs``; those
    without letters, or whose trigrams hardly occur in any profile, go. The limit is
    ``min_coverage`` or, if less, the language's own."""
    prepare_workers(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, coverage = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array(
                [x != "und" and c > 0 and c >= min(min_coverage, model.limits.get(x, min_coverage)) for x, c in zip(langs, coverage)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    return docs.where(F.pmod(crc32_of_id("doc_id"), F.lit(folds)) != held_out)
