"""Trie of the prefixes that rebuilt conversations share, from composable fingerprints.

Conversation c is rebuilt as the first h turns of its base (conversation c - c % 20) and
its own turns after its first h, h = crc32(c) % 4. No rebuilt text is ever made: a turn
is an affine map x -> a x + b modulo a prime, taken from the sha256 of its role and text,
and the fingerprint of a sequence is the product of its turns' maps, which is associative
and not commutative. The product of a base's head is composed with the running products
of c's own suffix. Long conversations are split by range; the parts' products compose too.

A rebuilt turn carries a reference (conv_id, place) to the first stored turn with equal
role and text. Rows of one fingerprint form a node; that all of them have the same
reference and the same parent is checked, so by induction they stand for equal sequences
(otherwise the job ends with an error).

Sums over subtrees need no walk: a node's own value is put on the row of its smallest
member, summed from each row onward along that member's path, and a node's subtree is
the sum of those over its members, since every node below belongs to exactly one of them.

Results for odd input: turns are ordered by ``turn`` (null first), then role and text;
null role or text is empty; rows with a null conv_id belong to no conversation; a
conversation that is rebuilt to nothing ends at the root; an empty table has no nodes.
Further columns are not read. Texts of any length go through JVM hashing whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import prepare_workers, stored
from lakeloom.llm.ranks import numbered, ranged, suffix_sums

BASE_STEP, MAX_HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
PRIME = (1 << 127) - 1
IDENTITY = f"{1:032x}{0:032x}"
#: Members whose ids are joined into one text before the texts of a node are hashed in order.
IDS_AT_ONCE = 4096


def element(digest: str) -> tuple[int, int]:
    """The map of a turn, from its sha256 in hex; a is never 0."""
    return int(digest[:32], 16) % (PRIME - 1) + 1, int(digest[32:], 16) % PRIME


def packed(f: tuple[int, int]) -> str:
    return f"{f[0]:032x}{f[1]:032x}"


def unpacked(s: str) -> tuple[int, int]:
    return int(s[:32], 16), int(s[32:], 16)


def then(f: tuple[int, int], g: tuple[int, int]) -> tuple[int, int]:
    """First f, then g."""
    return f[0] * g[0] % PRIME, (g[0] * f[1] + g[1]) % PRIME


def _added(batch: pa.RecordBatch, columns: dict[str, list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, pa.string()) for v in columns.values()]], names=[*batch.schema.names, *columns])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (conv_id, _part, place): the product of each run's elements
    before the row and with it."""
    key, held = None, (1, 0)
    for batch in batches:
        before, after = [], []
        for conv, part, digest in zip(batch["conv_id"].to_pylist(), batch["_part"].to_pylist(), batch["digest"].to_pylist()):
            if (conv, part) != key:
                key, held = (conv, part), (1, 0)
            before.append(packed(held))
            held = then(held, element(digest))
            after.append(packed(held))
        yield _added(batch, {"before": before, "after": after})


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, _part, head, whole) in order: what precedes each part of a conversation."""
    key, held = None, (1, 0)
    for batch in batches:
        out = []
        for conv, head, whole in zip(batch["conv_id"].to_pylist(), batch["head"].to_pylist(), batch["whole"].to_pylist()):
            if conv != key:
                key, held = conv, unpacked(head)
            out.append(packed(held))
            held = then(held, unpacked(whole))
        yield _added(batch, {"start": out})


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = [unpacked(s) for s in batch["start"].to_pylist()]
        yield _added(batch, {"parent": [packed(then(s, unpacked(p))) for s, p in zip(start, batch["before"].to_pylist())],
                             "fp": [packed(then(s, unpacked(p))) for s, p in zip(start, batch["after"].to_pylist())]})


def _with(df: DataFrame, function, *columns: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {c} string" for c in columns)
    return df.mapInArrow(function, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, part, place, ids) in order: one sha256 a node, fed text by text."""
    key, state = None, None
    for batch in batches:
        done = []
        for fp, ids in zip(batch["fp"].to_pylist(), batch["ids"].to_pylist()):
            if fp == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = fp, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["fp", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["fp", "ends_sha256"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, _part, n, digest, ref, words), stored: one row a turn, with the
    first stored turn of equal role and text."""
    text = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text.alias("content")).select(
        "conv_id", "turn", F.col("content.role").alias("role"), F.col("content.text").alias("text"))
    turns = stored(numbered(turns, ["conv_id"], ["turn", "role", "text"], "place", "n"), "turns")
    first = turns.groupBy("role", "text").agg(F.min(F.struct("conv_id", "place")).alias("ref"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    kept = turns.join(first, ["role", "text"]).select(
        "conv_id", "place", "_part", "n", digest.alias("digest"), "ref", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return stored(kept, "turn-references")


def rebuilt(turns: DataFrame, head: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, fp, parent, ref, words) of all rebuilt turns, and
    (conv_id, length) of all conversations. ``head``: turns taken from the base, at most 3."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_HEAD if head is None else head
    heads = turns.where((F.col("conv_id") % BASE_STEP == 0) & (F.col("place") < MAX_HEAD - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "ref", "words"))).alias("first_turns"))
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumn("h", head.cast("int"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE_STEP).join(heads, "base", "left")
    taken = F.when(F.col("h") > 0, F.slice("first_turns", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.slice("first_turns", 1, 0))
    convs = convs.withColumn("taken", taken).withColumn("from_base", F.coalesce(F.size("taken"), F.lit(0)))
    convs = stored(convs.select("conv_id", "n", "h", "from_base", "taken", (F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt-heads")

    # The base's head: at most three turns a conversation.
    copied = convs.select("conv_id", F.posexplode("taken").alias("place", "t")).select(
        "conv_id", F.lit(0).cast("long").alias("_part"), F.col("place").cast("long").alias("place"), "t.digest", "t.ref", "t.words")
    ordered = copied.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    copied = stored(_with(ordered, _running, "parent", "fp"), "rebuilt-heads")
    end = copied.join(convs.select("conv_id", F.col("from_base") - 1), ["conv_id"]).where(F.col("place") == F.col("(from_base - 1)"))
    end = end.select("conv_id", F.col("fp").alias("head"))

    # Its own turns after the first h: running products by part, what precedes each part, both composed.
    own = turns.join(convs.select("conv_id", "h", "from_base"), "conv_id").where("place >= h")
    own = own.repartition("conv_id", "_part").sortWithinPartitions("conv_id", "_part", "place")
    own = stored(_with(own, _running, "before", "after"), "own-products")
    parts = own.groupBy("conv_id", "_part").agg(F.max_by("after", "place").alias("whole")).join(end, "conv_id", "left").na.fill({"head": IDENTITY})
    starts = _with(parts.select("conv_id", "_part", "head", "whole").repartition("conv_id").sortWithinPartitions("conv_id", "_part"), _starts, "start")
    own = _with(own.join(starts.select("conv_id", "_part", "start"), ["conv_id", "_part"]), _composed, "parent", "fp")

    columns = ("fp", "parent", "ref", "words")
    rows = copied.select("conv_id", (F.col("place") + 1).alias("depth"), *columns).unionByName(
        own.select("conv_id", (F.col("place") - F.col("h") + F.col("from_base") + 1).alias("depth"), *columns))
    return stored(rows, "rebuilt-turns"), convs.select("conv_id", "length")


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(fp, ends_sha256) of the nodes at which conversations end."""
    last = rows.join(convs, "conv_id").where("depth = length").select("fp", "conv_id")
    last = last.unionByName(convs.where("length = 0").select(F.lit(IDENTITY).alias("fp"), "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ranged(last, ["fp"], ["conv_id"]).groupBy("fp", "_part", F.floor(F.col("_at") / IDS_AT_ONCE).alias("chunk")).agg(ids.alias("ids"))
    in_order = texts.repartition("fp").sortWithinPartitions("fp", "_part", "chunk")
    return in_order.mapInArrow(_hashed, "fp string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and ref (the stored turn that the node's last turn equals)."""
    prepare_workers(conversations.sparkSession)
    rows, convs = rebuilt(numbered_turns(conversations))
    same = F.assert_true((F.min("ref") == F.max("ref")) & (F.min("parent") == F.max("parent")), F.lit("one fingerprint, two sequences"))
    nodes = rows.groupBy("depth", "fp").agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("n_convs"), F.min("ref").alias("ref"),
                                            F.min("parent").alias("parent"), F.max("words").alias("words"), same.alias("verified"))
    root = convs.agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(IDENTITY).alias("fp"), "top", "n_convs", F.lit(None).cast("string").alias("parent"))
    nodes = nodes.where(F.col("verified").isNull()).drop("verified").unionByName(root, allowMissingColumns=True)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["depth", "fp"], "left").na.fill({"n_children": 0}), "trie-nodes")

    # Each node's values stand on its smallest member's row and count for every row before it on that path.
    places = rows.select("conv_id", "depth", "fp").unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(IDENTITY).alias("fp")))
    own = nodes.select(F.col("top").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved"),
                       (F.col("n_children") == 0).cast("long").alias("leaf"))
    placed = places.join(own, ["conv_id", "depth"], "left").na.fill({"saved": 0, "leaf": 0})
    sums = suffix_sums(placed, ["conv_id"], ["depth"], ["saved", "leaf"]).groupBy("depth", "fp").agg(
        F.sum("leaf_onward").alias("n_leaves"), F.sum("saved_onward").alias("saved_tokens"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("top").alias("parent_conv_id"))
    return nodes.join(sums, ["depth", "fp"]).join(above, ["depth", "parent"], "left").join(_ends(rows, convs), "fp", "left").select(
        F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "ref")
