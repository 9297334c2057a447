"""Near-duplicate classes by DartMinHash signatures and banded joins.

A document is a weighted set: its five-word shingles (lower-cased runs of letters
and digits; a text of one to four words is one shingle) weighted by their counts.
Two documents are linked if their weighted Jaccard similarity is at least 0.8,
and a class is a connected component of links.

**Signatures.** Every shingle owns an endless strip of the (weight, rank) plane.
Hashes throw darts onto it, one per unit of area on average, the same ones for
every document. A document's region is the strip below the shingle's weight; a
dart in the region with rank below ``t / total weight`` is kept, where
``t = k ln k + 2 k`` makes it likely that each of the ``k`` coordinates, to which
darts are hashed, gets one. A document with an empty coordinate is thrown again
with twice that ``t``. The earliest dart (least rank) of each coordinate is the
signature: two documents agree on a coordinate with the probability of their
similarity. Weights are cut into dyadic cells, so a shingle of weight ``w`` costs
``log w`` and not ``w``.

**Joins.** Equal texts are one node, found by an MD5 aggregation, so copies cost
one row each. ``ROWS`` coordinates make a band (25 bands of 5: a pair at 0.8 is
missed with probability 5e-5) and nodes that share a band share a bucket. Pairs whose
signatures agree on less than ``LEAST_AGREEMENT`` of the coordinates, five standard
deviations below 0.8, are not read; the others are verified exactly, on the shingle
counts. Only links that can join two components are looked for:

1. every member of a bucket against the bucket's smallest node;
2. in buckets that then hold several components, each stray (a member outside the
   bucket's largest component) against every member of another component.

Step 2 works in a grid of about ``STRAYS`` by ``MEMBERS`` rows a cell, so a bucket of any
size is spread over tasks of bounded size. A cell holds the members' signatures, bands
and shingles (as sorted 32-bit hashes, a repeated shingle's occurrences counted as
different ones), so it tests its pairs itself and no pair leaves it but a link: at most
one for each stray and component. A pair that shares several bands is tested in the
first one only, and links are verified once more on the 64-bit hashes. Members of one
component are never compared.

Defined cases: null text is a class of its own; texts without a word are
classed with equal texts only. Null doc_ids take part; a class's id is its
smallest doc_id (null if it has none). Repeated rows are copies. Empty tables
give empty results. Other columns are not read; ``keep`` returns the input's own
columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import mix64, prepare_workers, stored, word_hashes
from lakeloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
LEAST_AGREEMENT = 0.62
STRAYS, MEMBERS = 1024, 4096
CHUNK = 256
GOLDEN = 0x9E3779B97F4A7C15


def _salt(i: int) -> np.uint64:
    return np.uint64(GOLDEN * (i + 1) % (1 << 64))


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and count of each distinct shingle; ``words`` are the
    word hashes of all documents, ``ends`` each document's end in them."""
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[doc]
    w, h = words.view(np.uint64), np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        inside = at + j < ends[doc]
        part = mix64(w[np.minimum(at + j, max(len(w) - 1, 0))] + _salt(j)) if len(w) else h
        h += np.where(inside, part, _salt(99 + j))
    h = mix64(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int,
                    k: int = COORDINATES, darts: float | None = None) -> np.ndarray:
    """(docs, k) dart ids (uint64) of weighted sets given as (document number,
    element hash, weight > 0); rows of documents without elements are 0."""
    darts = darts or k * math.log(k) + 2 * k
    total = np.bincount(doc, weight, docs)
    cells = 1 + np.maximum(np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    of = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    low, width = np.where(cell, 2.0 ** (cell - 1), 0.0), np.where(cell, 2.0 ** (cell - 1), 1.0)
    region = mix64(element[of] + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN))
    top, limit, owner = weight[of], darts / total[doc[of]], doc[of]
    rank, live, slots, ranks, ids = np.zeros(len(of)), np.arange(len(of)), [], [], []
    throw = 0
    while len(live):
        h = mix64(region[live] + _salt(throw))
        gap = -np.log1p(-(h >> np.uint64(11)).astype(float) * 2.0 ** -53) / width[live]
        rank[live] += gap
        stay = rank[live] <= limit[live]
        live, h = live[stay], h[stay]
        place = mix64(h + np.uint64(GOLDEN))
        hit = low[live] + width[live] * ((place >> np.uint64(11)).astype(float) * 2.0 ** -53) < top[live]
        dart = mix64(place[hit] ^ h[hit])
        slots.append(owner[live][hit] * k + (dart % np.uint64(k)).astype(np.int64))
        ranks.append(rank[live][hit])
        ids.append(dart)
        throw += 1
    out, seen = np.zeros(docs * k, np.uint64), np.zeros(docs * k, bool)
    if slots:
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out[slot[first]], seen[slot[first]] = dart[first], True
    out, short = out.reshape(docs, k), ~seen.reshape(docs, k).all(1) & (total > 0)
    if short.any():
        rows = np.flatnonzero(short)
        again = short[doc]
        number = np.zeros(docs, np.int64)
        number[rows] = np.arange(len(rows))
        out[rows] = dart_signatures(number[doc[again]], element[again], weight[again], len(rows), k, 2 * darts)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends of an Arrow list column without nulls."""
    ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0)), dtype=np.int64)
    return np.asarray(column.flatten()), ends


SKETCH = T.StructType([
    T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def sketch(rows: DataFrame) -> DataFrame:
    """SKETCH of rows (uid, doc_id, text); wordless texts have no bands."""
    prepare_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = _lists(batch.column(3))
            doc, h, n = shingles(words, ends)
            sig = dart_signatures(doc, h, n.astype(float), len(ends))
            bands = np.zeros((len(ends), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix64(bands + sig[:, r * BANDS:(r + 1) * BANDS])
            bands = mix64(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(GOLDEN)).view(np.int64)
            has = np.diff(np.concatenate([[0], ends])) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[has].ravel())),
                 pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], names=SKETCH.names)

    ready = rows.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("key"),
                        word_hashes(F.col("text")).alias("words"))
    return ready.mapInArrow(run, SKETCH)


def elements(words: np.ndarray) -> np.ndarray:
    """The shingles of a text as sorted 32-bit hashes, its weighted set as a set."""
    _, h, n = shingles(words, np.array([len(words)]))
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort((mix64(np.repeat(h, n) + turn.astype(np.uint64)) >> np.uint64(32)).astype("<u4"))


def _with_elements(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = _lists(batch.column(1))
            made = [elements(w).tobytes() for w in np.split(words, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "elements"])

    return texts.select("node", "words").mapInArrow(run, "node long, elements binary")


def _bytes(column: list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, COORDINATES)


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree on enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_bytes(c.to_pylist()) for c in batch.columns[2:])
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT, pa.bool_()))

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _cell_links(bucket: int, stray: np.ndarray, node: np.ndarray, label: np.ndarray, main: np.ndarray, sig: np.ndarray,
                bands: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (stray, member) of one cell: one for each stray and component."""
    cols = np.flatnonzero(~stray)
    sizes = np.array([len(s) for s in sets])
    for r in np.flatnonzero(stray):
        # two strays meet twice: once is enough
        may = (label[cols] != label[r]) & (main[cols] | (node[r] < node[cols]))
        agree = (sig[cols] == sig[r]).sum(1)
        at = np.flatnonzero(may & (agree >= LEAST_AGREEMENT * COORDINATES))
        if not len(at):
            continue
        at = at[np.lexsort((node[cols[at]], -agree[at]))]
        at = at[bands[r][(bands[cols[at]] == bands[r]).argmax(1)] == bucket]
        own, found = sets[r], set()
        while len(at):
            some, at = cols[at[:CHUNK]], at[CHUNK:]
            flat = np.concatenate([sets[c] for c in some])
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat(own[place] == flat, np.cumsum(sizes[some]) - sizes[some])
            hits = some[common >= SIMILARITY * (sizes[some] + len(own) - common) - 1e-9]
            for c in hits.tolist():
                if label[c] not in found:
                    found.add(label[c])
                    yield int(node[r]), int(node[c])
            if found:
                at = at[~np.isin(label[cols[at]], list(found))]


def _grid(opened: DataFrame) -> DataFrame:
    """Links (a, b) between strays and members of open buckets. ``opened`` is (bucket,
    node, label, most, n, strays, sig, bands, elements)."""
    down = F.ceil(F.col("strays") / STRAYS).cast("int")
    across = F.ceil(F.col("n") / MEMBERS).cast("int")
    own = ["node", "label", "main", "sig", "bands", "elements"]
    sized = opened.select("bucket", down.alias("down"), across.alias("across"), (F.col("label") == F.col("most")).alias("main"), *[c for c in own if c != "main"])
    member = sized.select("bucket", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod(F.hash("node", F.lit(1)), F.col("across")).alias("j"),
                          F.lit(False).alias("stray"), *own)
    stray = sized.where("not main").select("bucket", F.pmod(F.hash("node", F.lit(2)), F.col("down")).alias("i"),
                                           F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), F.lit(True).alias("stray"), *own)
    cells = member.union(stray).select(F.xxhash64("bucket", "i", "j").alias("cell"), "bucket", "stray", *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, bucket, stray, node, label, main = (table.column(i).to_numpy() for i in range(6))
            edges = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
            out, a = [], 0
            for b in edges.tolist():
                part = table.slice(a, b - a)
                sig = _bytes(part.column(6).to_pylist())
                bands = np.asarray(part.column(7).combine_chunks().flatten()).reshape(-1, BANDS)
                sets = [np.frombuffer(x, "<u4") for x in part.column(8).to_pylist()]
                out += _cell_links(bucket[a], stray[a:b], node[a:b], label[a:b], main[a:b], sig, bands, sets)
                a = b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cell = held.column(0).to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield from links(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from links(held)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def weighted_jaccard_at_least(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Exact test on the word hashes of two texts."""
    _, hx, nx = shingles(x, np.array([len(x)]))
    _, hy, ny = shingles(y, np.array([len(y)]))
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    common = int(np.minimum(nx[i], ny[j]).sum())
    return common >= least * (int(nx.sum() + ny.sum()) - common) - 1e-9


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xe), (y, ye) = _lists(batch.column(2)), _lists(batch.column(3))
            xs, ys = np.split(x, xe[:-1]), np.split(y, ye[:-1])
            yield batch.select([0, 1]).filter(
                pa.array([weighted_jaccard_at_least(p, q) for p, q in zip(xs, ys)], pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _links(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Labels (node, label) of all linked nodes; ``nodes`` is (node, bands, sig)."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    members = stored(rows.join(shared.select("bucket", "centre"), "bucket"), "dedup-buckets")
    if members.isEmpty():
        return None
    texts = stored(texts_of(members.select("node").distinct()), "dedup-texts")
    sigs = nodes.select("node", "sig", "bands").join(members.select("node").distinct(), "node", "left_semi")
    sigs = stored(sigs, "dedup-signatures")

    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    star = distinct(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    links = stored(_verified(_agreeing(star, sigs), texts), "dedup-links")
    labels = components(links)
    labelled = members.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label"))
    groups = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_buckets = groups.groupBy("bucket").agg(
        F.max_by("label", "n").alias("most"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
    opened = stored(labelled.join(open_buckets, "bucket"), "dedup-open")
    open_texts = texts.join(opened.select("node").distinct(), "node", "left_semi")
    payload = stored(_with_elements(open_texts).join(sigs, "node"), "dedup-elements")
    found = stored(_verified(distinct(_grid(opened.join(payload, "node"))), texts), "dedup-more-links")
    return labels if found.isEmpty() else components(links.union(found))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, fixed by writing it."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "dedup-rows"), name


def _classed(rows: DataFrame) -> DataFrame:
    """uid, doc_id and (class_id, class_size, first) of rows (uid, doc_id, text);
    ``first`` marks the one row that stands for its class."""
    sketches = stored(sketch(rows), "dedup-sketches")
    keys = sketches.where("key is not null").groupBy("key").agg(
        F.min("uid").alias("node"), F.min_by("uid", "doc_id").alias("first_uid"),
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).select(
            "key", "node", F.coalesce("first_uid", "node").alias("first_uid"), "first_id", "copies")
    keys = stored(keys, "dedup-keys")
    nodes = sketches.where(F.size("bands") > 0).select(F.col("uid").alias("node"), "bands", "sig").join(
        keys.select("node"), "node", "left_semi")

    def texts_of(wanted: DataFrame) -> DataFrame:
        texts = rows.select(F.col("uid").alias("node"), "text").join(wanted, "node", "left_semi")
        return texts.select("node", word_hashes(F.col("text")).alias("words"))

    labels = _links(nodes, texts_of)
    named = keys.withColumn("label", F.col("node")) if labels is None else keys.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(
        F.min("first_id").alias("class_id"), F.coalesce(F.min_by("first_uid", "first_id"), F.min("first_uid")).alias("stands"),
        F.sum("copies").alias("class_size"))
    by_key = named.select("key", "label").join(classes, "label").select("key", "class_id", "stands", "class_size")
    return sketches.select("uid", "doc_id", "key").join(by_key, "key", "left").select(
        "uid", "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("stands") == F.col("uid"), F.lit(True)).alias("first"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the class's smallest doc_id) and
    class_size (documents of the class)."""
    rows, uid = _numbered(docs.select("doc_id", "text"))
    return _classed(rows.withColumnRenamed(uid, "uid")).select("doc_id", "class_id", "class_size")


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with the columns
    of ``docs``."""
    rows, uid = _numbered(docs)
    gone = _classed(rows.select(F.col(uid).alias("uid"), "doc_id", "text")).where("not first").select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*docs.columns)
