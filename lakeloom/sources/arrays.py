"""JSON arrays read by byte ranges: a large file is many tasks, and no file is one row.

The text source cuts files into ranges and hands over the fragments between closing
braces, each to the range it begins in. Where an element of the array ends depends on
what stands before: whether a fragment begins inside a string (parity of the unescaped
quotes before it) and how deep in brackets (openings less closings outside strings). Both
are sums over earlier fragments: summed inside a range, and over the small per-range
totals of a file. A closing brace outside strings at depth 1 ends a group; a group is one
object, with any plain values before it, and is parsed on its own. The places of elements
are once more such a sum.

The result equals parsing the file whole: a file with a group that doesn't parse, a
missing or surplus comma, or brackets that never close is no array and gives no record.
Text behind the closing bracket also fails the file; a whole-file parse stops there. A file without a closing brace (plain values only, or broken) is one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.config import EventSpec
from lakeloom.functions.contract import invalid_timestamp
from lakeloom.functions.paths import relative_path
from lakeloom.session import scratch_dir
from lakeloom.sources.landing import ScanScope, _locations, only_files

# Fixed value: file verdict texts.
NOT_AN_ARRAY = "file is not a JSON array"
STRICT_TS = "invalid event_timestamp (strict)"

RANGE = ["_filename", "block"]


def read_fragments(spark: SparkSession, root: str, scope: ScanScope, files: DataFrame) -> DataFrame:
    """(_filename, size, block, at, value): the stretches between closing braces of the
    files named, ``at`` unique, and ascending inside a byte range (``block``). Written once,
    since the marks and the parse go over it."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(_locations(root, scope.prefixes))
    found = only_files(text, files, F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    out = scratch_dir(spark, "fragments")
    found.select(relative_path(F.col("path"), root).alias("_filename"), "size", "block",
                 F.monotonically_increasing_id().alias("at"), "value").write.parquet(out)
    return spark.read.parquet(out)


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a prefix sum goes over its input
    twice (totals, then rows), so without it each sum would double all work before it."""
    out = scratch_dir(df.sparkSession, "fragments")
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _before(df: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows of the file."""
    totals = df.groupBy(*RANGE).agg(F.sum(value).alias("_total"))
    ranges = Window.partitionBy("_filename").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*RANGE, F.coalesce(F.sum("_total").over(ranges), F.lit(0)).alias("_earlier"))
    here = Window.partitionBy(*RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(earlier, RANGE).withColumn(name, F.col("_earlier") + F.coalesce(F.sum(value).over(here), F.lit(0))).drop("_earlier")


def _brackets(bare: Column, inside: bool) -> Column:
    """Depth change over a fragment without escapes, the least depth on the way, and that
    before the last bracket. Strings are taken out first."""
    outside = F.regexp_replace(bare, '^[^"]*+"?', "") if inside else bare
    kept = F.regexp_replace(F.regexp_replace(outside, '"[^"]*+("|$)', ""), r"[^\[\]{}]", "")
    each = F.filter(F.split(kept, ""), lambda c: c != "")
    high = F.lit(1 << 30)
    start = F.struct(F.lit(0).alias("depth"), high.alias("least"), high.alias("least_but_last"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("[", "{"), F.lit(1)).otherwise(F.lit(-1))
        return F.struct(depth.alias("depth"), F.least(a["least"], depth).alias("least"), a["least"].alias("least_but_last"))
    return F.aggregate(each, start, step)


def _braced(b: Column) -> Column:
    """The same with the closing brace behind the fragment."""
    depth = b["depth"] - 1
    return F.struct(depth.alias("depth"), F.least(b["least"], depth).alias("least"), b["least"].alias("least_but_last"))


def groups(fragments: DataFrame) -> DataFrame:
    """(_filename, block, group, last, sound, text): the stretches to parse on their own.

    The texts are read once to mark each fragment, its brackets both for a beginning
    outside and inside a string, and once to be joined; all sums go over the marks.
    """
    bare = fragments.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))
    marks = _stored(bare.select(
        "_filename", "size", "block", "at", F.octet_length("value").alias("bytes"),
        (F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))).alias("quotes"),
        _brackets(F.col("bare"), False).alias("outer"), _brackets(F.col("bare"), True).alias("inner")))
    ends = marks.groupBy("_filename").agg(
        F.max(F.struct("block", "at")).alias("_end"),
        (F.first("size") - F.sum("bytes") - F.count(F.lit(1)) + 1).alias("_braces_at_end"))
    rows = marks.join(ends, "_filename").withColumn("last", F.struct("block", "at") == F.col("_end"))
    rows = rows.withColumn("closed", ~F.col("last") | (F.col("_braces_at_end") > 0))
    rows = _before(rows.drop("_end", "_braces_at_end", "size", "bytes"), F.col("quotes"), "quotes_before", "at")
    inside, open_at_end = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    rows = rows.withColumn("open_at_end", open_at_end).withColumn("b", F.when(inside, F.col("inner")).otherwise(F.col("outer")))
    b = F.when(F.col("closed") & ~F.col("open_at_end"), _braced(F.col("b"))).otherwise(F.col("b"))
    rows = _stored(rows.select(*RANGE, "at", "last", "closed", "open_at_end", b.alias("b")))
    rows = _before(rows, F.col("b.depth"), "depth", "at")
    after = F.col("depth") + F.col("b.depth")
    rows = rows.withColumn("ends_group", (F.col("closed") & ~F.col("open_at_end") & (after == 1)).cast("int"))
    rows = rows.withColumn("sound", F.when(F.col("last"), ~F.col("closed") & (after == 0) & (F.col("depth") + F.col("b.least_but_last") >= 1))
                           .otherwise(F.col("depth") + F.col("b.least") >= 1))
    rows = _stored(rows.select(*RANGE, "at", "last", "closed", "ends_group", "sound"))
    rows = _before(rows, F.col("ends_group"), "group", "at").join(fragments.select("at", "value"), "at")
    part = F.struct("block", "at", F.concat("value", F.when(F.col("closed"), F.lit("}")).otherwise(F.lit(""))).alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "")
    return rows.groupBy("_filename", "group").agg(F.min("block").alias("block"), F.max("last").alias("last"),
                                                 F.min("sound").alias("sound"), joined.alias("text"))


class SplitArrays:
    """Files parsed by byte ranges. ``read`` gives the fragments of the files named
    (``read_fragments``). Same results as ``WholeFiles`` of ``plans/ingest.py``."""

    def __init__(self, spec: EventSpec, read: Callable[[DataFrame], DataFrame], strict: bool = False):
        self.spec, self.read, self.strict = spec, read, strict

    def _parsed(self, files: DataFrame) -> DataFrame:
        """(_filename, block, group, _records, _wrong) by group."""
        first, last, body, blank = F.col("group") == 0, F.col("last"), F.col("body"), F.col("blank")
        lead = F.when(first, F.lit(r"^\s*\[")).otherwise(F.lit(r"^\s*,"))
        rows = groups(self.read(files))
        rows = rows.withColumn("body", F.when(last, F.regexp_replace("text", r"\s*\]\s*$", "")).otherwise(F.col("text")))
        rows = rows.withColumn("blank", ~body.rlike(r"\S"))
        rows = rows.withColumn("_records", F.from_json(
            F.concat(F.lit("["), F.when(blank, F.lit("")).otherwise(F.regexp_replace(body, lead, F.lit(""))), F.lit("]")), "array<variant>"))
        # A first group may hold nothing ([]); a later one begins with a comma and holds something, but for the closing bracket alone.
        shaped = F.when(first, body.rlike(r"^\s*\[")).otherwise(
            F.when(last & blank, F.lit(True)).otherwise(body.rlike(r"^\s*,") & (F.size("_records") > 0)))
        wrong = F.when(~F.col("sound") | ~shaped | F.col("_records").isNull(), F.lit(NOT_AN_ARRAY))
        if self.strict:
            wrong = wrong.when(F.exists("_records", lambda r: invalid_timestamp(r, self.spec.timestamp_field)), F.lit(STRICT_TS))
        return rows.select("_filename", "block", "group", "_records", wrong.alias("_wrong"))

    def records(self, files: DataFrame) -> DataFrame:
        """(_filename, _pos, payload) of the files without an error."""
        rows = _stored(self._parsed(files).select(*RANGE, "group", "_wrong", F.posexplode_outer("_records").alias("_at", "payload")))
        bad = rows.where(F.col("_wrong").isNotNull()).select("_filename").distinct()
        good = rows.join(bad, "_filename", "left_anti").where("_at IS NOT NULL").select(*RANGE, "group", "_at", "payload")
        placed = _before(good, F.lit(1), "_pos", "group", "_at")
        return placed.select("_filename", F.col("_pos").cast("int").alias("_pos"), "payload")

    def errors(self, files: DataFrame) -> DataFrame:
        """(_filename, _file_error), the error null for ``[]``."""
        # The text NOT_AN_ARRAY comes before STRICT_TS: what is no array has no timestamps.
        return self._parsed(files).groupBy("_filename").agg(F.min("_wrong").alias("_file_error"))
