"""Merkle manifest of a dataset, with a proof for every row, as nested structs.

Each row is a leaf: sha256 over its fields, each as ``-`` (null) or byte count, ``:``
and value. Leaves are numbered within their source; the base-16 digits of that number
are grouped away one after another, so that 16 sibling nodes become an array of structs
in their parent's row and the parent's digest is the hash of theirs. After three digits
a row is a block of at most 4,096 nodes; the block roots go through the same again until
one node a source is left (its subroot), and the subroots once more up to the root.

Proofs come from the way back: a block row gets the siblings above it, then a transform
puts the left and right siblings beside every child and an explode makes rows of the
children. No child is joined with its parents; a block and what stands above it meet in
one aggregate by block.

Results for odd input: null fields count as ``-``; leaves with a null id come first in
their source; rows with equal ids stand in the order of their digests; a source of one
row has its leaf as its subroot, with no siblings; a null source is a source of its own and
comes first; an empty table gives no rows. Further columns are not read. Equal rows are
equal leaves at different places.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import crc32_of_id, stored
from lakeloom.llm.ranks import numbered

FANOUT_BITS = 4
#: Digits grouped away before a block is closed: 16 ** 3 nodes a row at most.
DIGITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    each = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")))
            for f in fields]
    return F.sha2(F.concat(*each), 256)


def lower_case_every_fifth(docs: DataFrame) -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the id, else as it is."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0, lowered).otherwise(F.col("text"))


def _lifted(size: str, level: int) -> Column:
    """Whether the nodes of this level (from 1, within a block) are hashed together: a
    group that has come down to one node keeps it."""
    return F.col(size) > (1 << FANOUT_BITS * (level - 1))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, size, rank, digest, item) -> (g, size, block, digest, kids), kids nested ``DIGITS`` deep."""
    fan = 1 << FANOUT_BITS
    rows, inner = nodes, "item"
    for level in range(1, DIGITS + 1):
        child = F.struct((F.col("rank") % fan).cast("int").alias("digit"), "digest", F.col(inner).alias("inner"))
        rows = rows.withColumn("rank_up", F.shiftright("rank", FANOUT_BITS)).groupBy("g", "size", "rank_up").agg(
            F.sort_array(F.collect_list(child)).alias("kids")).withColumnRenamed("rank_up", "rank")
        digests = F.transform("kids", lambda k: k["digest"])
        rows = rows.withColumn("digest", F.when(_lifted("size", level), F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0]))
        inner = "kids"
    return rows.withColumnRenamed("rank", "block")


def _opened(blocks: DataFrame) -> DataFrame:
    """Blocks with ``path`` and ``root`` -> their innermost nodes (g, rank, digest, item),
    the path begun with the siblings inside the block."""
    rows = blocks.withColumnRenamed("block", "rank")
    for level in range(DIGITS, 0, -1):
        def beside(k: Column, i: Column) -> Column:
            digests = F.transform("kids", lambda x: x["digest"])
            return F.struct(k["digit"].alias("digit"), k["digest"].alias("digest"), k["inner"].alias("inner"),
                            F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"),
                            F.array_join(F.slice(digests, i + 2, F.lit(1 << FANOUT_BITS)), "").alias("right"))
        rows = rows.select("g", "size", "rank", "path", "root", F.explode(F.transform("kids", beside)).alias("k"))
        siblings = F.array(F.struct(F.col("k.left").alias("left"), F.col("k.right").alias("right")))
        rows = rows.select("g", "size", (F.shiftleft("rank", FANOUT_BITS) + F.col("k.digit")).alias("rank"),
                           F.when(_lifted("size", level), F.concat(siblings, "path")).otherwise(F.col("path")).alias("path"),
                           "root", F.col("k.digest").alias("digest"), F.col("k.inner").alias("kids"))
    return rows.withColumnRenamed("kids", "item")


def _meet(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each block's row with the path and root that ``above`` holds for (g, block)."""
    both = blocks.unionByName(above, allowMissingColumns=True)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("size", "kids", "path", "root")]
    return both.groupBy("g", "block").agg(*first)


def _tree(leaves: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Roll the numbered leaves of every group up to one node. ``close`` gets (g, digest)
    of the last nodes and gives (g, path, root); then the way back to the leaves."""
    passes, nodes = [], leaves
    while True:
        blocks = stored(_blocks(nodes), "merkle-blocks")
        passes.append(blocks)
        nodes = blocks.select("g", F.ceil(F.col("size") / (1 << FANOUT_BITS * DIGITS)).cast("long").alias("size"),
                              F.col("block").alias("rank"), "digest", F.struct(F.lit(0).alias("none")).alias("item"))
        if (nodes.agg(F.max("size").alias("m")).first().m or 0) <= 1:
            break
    above = close(nodes.select("g", "digest")).withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(passes):
        opened = _opened(_meet(blocks.drop("digest"), above))
        above = opened.select("g", F.col("rank").alias("block"), "path", "root")
    return opened


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a
    document; ``tampered_text`` replaces the text of the leaf that is checked against
    the proof (by default the text itself)."""
    fields = [F.col(c) for c in FIELDS]
    changed = F.col("text") if tampered_text is None else tampered_text
    leaves = docs.select("doc_id", F.col("source").alias("g"), leaf_digest(fields).alias("digest"),
                         leaf_digest([*fields[:-1], changed]).alias("checked"))
    leaves = numbered(leaves, ["g"], ["doc_id", "digest", "checked"]).select(
        "g", "size", "rank", "digest", F.struct("doc_id", "checked").alias("item"))

    def over_sources(subroots: DataFrame) -> DataFrame:
        tops = numbered(subroots.select(F.lit(0).alias("all"), F.col("g").alias("source"), "digest"), ["all"], ["source", "digest"])
        tops = tops.select(F.col("all").alias("g"), "size", "rank", "digest", F.struct("source", F.col("digest").alias("subroot")).alias("item"))
        empty = F.array().cast("array<struct<left:string,right:string>>")
        found = _tree(tops, lambda top: top.select("g", empty.alias("path"), F.struct(F.lit("").alias("subroot"), F.col("digest").alias("root")).alias("root")))
        return stored(found.select(F.col("item.source").alias("g"), "path", F.struct(F.col("item.subroot").alias("subroot"), F.col("root.root").alias("root")).alias("root")), "merkle-sources")

    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("item.checked"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    rows = _tree(leaves, over_sources).select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("root.subroot").alias("subroot"),
        F.col("root.root").alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
