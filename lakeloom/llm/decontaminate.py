"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is contaminated by a test item if it holds at least 0.8 of the item's
distinct five-word shingles (lower-cased runs of letters and digits). An item of one
to four words is held by a document in which these words stand one after another.

**Sketches.** A document falls into the size class ``c`` with at most ``2**c``
distinct shingles. Its class cuts the 64-bit hash range into ``2**(c + e)`` bins;
the least shingle hash of each bin is the sketch (one-permutation MinHash with a
number of values that follows the size class, so a short item isn't lost in a long
document). A shingle that item and document share is the least of the document's
bin with probability ``(1 - exp(-x)) / x``, where ``x <= 2**-e`` is the mean number
of shingles a bin holds. ``e`` is chosen so that an item of the benchmark's smallest
size, of which 0.8 is present, is missed with a probability of at most ``MISS``:
large items allow coarse bins. An item's own sketch depends on the class of the
document it is looked up in; instead of a copy for each class, a shingle carries
the smallest class in which it is its bin's least.

**Search and check.** Sketch values are looked up in the items' sketches; pairs
that meet are candidates, and only their documents' shingles are then counted
exactly. Equal texts are one document here, by the MD5 of the text. The items'
table is broadcast if a count finds at most ``BROADCAST_ROWS`` rows, and so are
the candidates' keys; beyond that both are shuffled joins. Items of fewer than five
words are looked up by a hash of all their words among the documents' n-grams of the
lengths that such items have; without such items no document is read for them.

Everything is built-in DataFrame functions. Defined cases: null text holds nothing, and
texts of fewer than five words hold short items only; items without a word or with null
text can't be found and take no part. A short item is reported as one shingle (shared
and item_shingles 1). Items that repeat an item_id are searched
each and reported once, with the highest containment. Null doc_ids and repeated
rows are reported each. Empty tables give empty results. Other columns are not
read; ``keep`` returns the input's own columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import stored, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
BROADCAST_ROWS = 1_000_000


def needed(size: int) -> int:
    """Shingles of an item of ``size`` shingles that make a containment."""
    return math.ceil(CONTAINMENT * size - 1e-9)


def extra_bits(smallest_item: int) -> int:
    """``e``: the least number of extra bits with a miss of at most MISS."""
    for e in range(-10, 40):
        x = 2.0 ** -e
        if (1 + math.expm1(-x) / x) ** needed(smallest_item) <= MISS:
            return e
    return 40


def _ngrams(n: int) -> Column:
    """The distinct hashes of ``n`` successive words of the array ``w``."""
    each = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(n))))
    return F.when(F.size("w") >= n, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))


def with_shingles(rows: DataFrame, text: str, *columns: str | Column) -> DataFrame:
    """``columns`` and ``s``, the sorted distinct shingle hashes of the text. Rows
    are not filtered here, and arrays are exploded with ``explode_outer``: Spark would
    push a filter on ``w`` or ``s`` below their projections and compute them once per
    element."""
    words = rows.select(*columns, word_hashes(F.col(text)).alias("w"))
    names = [c for c in words.columns if c != "w"]
    listed = words.select(*names, _ngrams(SHINGLE).alias("s"))
    return listed.select(*names, F.sort_array("s").alias("s"))


def _bin(hash_: Column, bits: Column) -> Column:
    """The top ``bits`` (0 to 64) of a hash, as a number."""
    return F.when(bits <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", hash_, F.least(64 - bits, F.lit(63))))


def document_sketches(docs: DataFrame, e: int) -> DataFrame:
    """key (MD5 of the text), class and sketch value, a row for each value."""
    rows = with_shingles(docs, "text", F.md5(F.col("text").cast("binary")).alias("key"))
    sized = rows.select("key", "s", F.ceil(F.log2(F.greatest(F.size("s"), F.lit(1)).cast("double"))).cast("int").alias("class"))
    sized = sized.select("key", "s", "class", F.greatest(F.lit(0), F.least(F.lit(64), F.col("class") + e)).alias("bits"))
    least = F.filter("s", lambda x, i: (i == 0) | (_bin(x, F.col("bits")) != _bin(F.get("s", i - 1), F.col("bits"))))
    return sized.select("key", "class", F.explode_outer(least).alias("hash"))


def item_rows(benchmark: DataFrame) -> DataFrame:
    """A row per distinct item text and shingle: item (MD5 of the text), size, hash,
    common: how many leading bits the hash shares with the item's next smaller one
    (-1: there is none)."""
    texts = benchmark.select("text", F.md5(F.col("text").cast("binary")).alias("item")).where("item is not null").dropDuplicates(["item"])
    each = with_shingles(texts, "text", "item").select("item", "s", F.posexplode_outer("s").alias("at", "hash"))
    common = F.when(F.col("at") == 0, -1).otherwise(64 - F.length(F.bin(F.expr("hash ^ get(s, at - 1)"))))
    return each.select("item", F.size("s").alias("size"), "hash", common.alias("common")).where("hash is not null")


def short_item_rows(benchmark: DataFrame) -> DataFrame:
    """item (MD5 of the text), words (their number) and hash of the distinct item texts
    of one to SHINGLE - 1 words; words that aren't there are null, which a hash skips."""
    texts = benchmark.select("text", F.md5(F.col("text").cast("binary")).alias("item")).where("item is not null").dropDuplicates(["item"])
    words = texts.select("item", word_hashes(F.col("text")).alias("w")).select(
        "item", F.size("w").alias("words"), F.xxhash64(*(F.get("w", F.lit(j)) for j in range(SHINGLE - 1))).alias("hash"))
    return words.where((F.col("words") > 0) & (F.col("words") < SHINGLE))


def holding_short(docs: DataFrame, short: DataFrame, lengths: list[int], rows: int) -> DataFrame:
    """key, item, shared and size of the texts and the short items they hold."""
    words = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), word_hashes(F.col("text")).alias("w"))
    grams = F.concat(*(F.transform(_ngrams(n), lambda h: F.struct(F.lit(n).alias("words"), h.alias("hash"))) for n in lengths))
    each = words.select("key", F.explode_outer(grams).alias("g")).select("key", "g.words", "g.hash")
    return each.join(_small(short, rows), ["words", "hash"]).select(
        "key", "item", F.lit(1).cast("long").alias("shared"), F.lit(1).alias("size")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def holding_long(docs: DataFrame, items: DataFrame, rows: int, least: int) -> DataFrame:
    """key, item, shared and size of the texts and the items of ``item_rows`` they hold."""
    e = extra_bits(least)
    # the bins of class c have c + e bits: the shingle is its bin's least once those tell it from the one before
    sketch = items.select("hash", "item", (F.col("common") + 1 - e).alias("from_class"))
    met = document_sketches(docs, e).join(_small(sketch, rows), "hash").where(
        (F.col("class") >= F.col("from_class")) | (F.col("from_class") + e <= 0))
    candidates = stored(met.select("key", "item").distinct(), "bench-candidates")
    keys = candidates.select("key").distinct()
    texts = docs.select("text", F.md5(F.col("text").cast("binary")).alias("key")).join(
        _small(keys, candidates.count()), "key", "left_semi").dropDuplicates(["key"])
    each = with_shingles(texts, "text", "key").select("key", F.explode_outer("s").alias("hash"))
    counts = each.join(_small(items.select("hash", "item", "size"), rows), "hash").groupBy(
        "key", "item").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    return counts.where(F.col("shared") >= CONTAINMENT * F.col("size") - 1e-9).join(candidates, ["key", "item"], "left_semi")


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """key, item_id, shared, size of all contaminated texts (None: no item can be
    searched)."""
    items = stored(item_rows(benchmark), "bench-items")
    short = stored(short_item_rows(benchmark), "bench-short")
    found = items.agg(F.count("*").alias("n"), F.min("size").alias("least")).first()
    lengths = {r["words"]: r["count"] for r in short.groupBy("words").count().collect()}  # at most SHINGLE - 1 rows
    parts = []
    if found["n"]:
        parts.append(holding_long(docs, items, found["n"], found["least"]))
    if lengths:
        parts.append(holding_short(docs, short, sorted(lengths), sum(lengths.values())))
    if not parts:
        return None
    sure = reduce(DataFrame.unionByName, parts)
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("item")).distinct()
    best = sure.join(ids, "item").groupBy("key", "item_id").agg(F.max_by(F.struct("shared", "size"), F.col("shared") / F.col("size")).alias("b"))
    return stored(best.select("key", "item_id", F.col("b.shared").alias("shared"), F.col("b.size").cast("long").alias("size")), "bench-contained")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, shared (item
    shingles present), item_shingles, containment."""
    found = contained(docs, benchmark)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shared long, item_shingles long, containment double")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"))
    return ids.join(_small(found, found.count()), "key").select(
        "doc_id", "item_id", "shared", F.col("size").alias("item_shingles"), (F.col("shared") / F.col("size")).alias("containment"))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns of ``docs``."""
    found = contained(docs, benchmark)
    if found is None:
        return docs
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = found.select(F.col("key").alias(name)).distinct()
    return docs.join(_small(gone, found.count()), F.md5(F.col("text").cast("binary")) == F.col(name), "left_anti")
