"""URL filter by path templates: rules first, then a template tree per host.

**Parts.** The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. Null, or no
``://``: both are empty.

**Rules** name a host and a path prefix. A rule fits its host and all subdomains if
the path starts with the rule's; the longest fitting rule (ties: the first in
alphabetical order) decides, and such pages label their templates.

**Template tree.** The paths of a host are a tree of segments, of which the first
``DEPTH`` are followed and the rest is ``**``. Going down a level at a time:

* a segment of digits, with or without a file extension, or a long mixed
  hexadecimal one becomes a wildcard by its form;
* below a node whose pages have at least ``MANY`` different children, of which each
  is rare (at least ``RARE`` children per page), every other segment becomes ``*``.

First-level branches of a host are merged into one ``*`` branch if their statistics
agree: as many different sub-templates with the same first and last one, and the
same verdict class of their labels (block or allow: the 95 % Wilson interval of the
blocked share lies above or below one half; mixed; none).

**Purity.** A template with ``b`` blocked and ``a`` allowed labelled pages has the
smoothed purity ``(b + ALPHA * p) / (b + a + ALPHA)``, where ``p`` is the blocked share
of all labelled pages. It is rejected from ``REJECT_FROM`` on, if it has a blocked
page at all; pages that no rule decides take their template's verdict.

Everything is built-in DataFrame functions; the statistics are aggregated to
distinct paths first, so a host with a third of all pages shuffles as counts.

Defined cases: an empty path has the template ``""``. Null page_ids and repeated rows
are judged each. Without rules everything is allowed. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import stored

DEPTH = 4
MANY, RARE = 10, 0.5
ALPHA = 2.0
REJECT_FROM = 0.8
Z = 1.96


def url_parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest fitting rule, written as host and path prefix (``net/``)."""
    found = F.lit(None).cast("string")
    for rule in sorted(sorted(rules, reverse=True), key=len):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _token(segment: Column) -> Column:
    return (F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.substring_index(segment, ".", -1)))
            .when(segment.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), F.lit("{id}")))


def templates(paths: DataFrame) -> DataFrame:
    """Distinct (host, path, n, b, a) with their ``template`` before merging."""
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.slice(F.split("path", "/"), 2, 1 << 30))
    rows = paths.select("*", segments.alias("segments"), F.lit("").alias("template"))
    for level in range(DEPTH):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = rows.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("n"))
        nodes = children.where(_token(F.col("segment")).isNull()).groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("n").alias("pages"))
        varied = nodes.where((F.col("children") >= MANY) & (F.col("children") >= RARE * F.col("pages"))).select(
            "host", "template", F.lit("*").alias("star"))
        step = F.coalesce(_token(F.col("segment")), "star", "segment")
        rows = rows.join(varied, ["host", "template"], "left").withColumn(
            "template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))).drop("star", "segment")
        rows = stored(rows, "url-level")  # counts of distinct paths; keeps the plans small
    deep = F.size("segments") > DEPTH
    return rows.withColumn("template", F.when(deep, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("segments")


def _class(b: Column, a: Column) -> Column:
    n = b + a
    p, half = b / n, Z * F.sqrt((b / n) * (a / n) / n + Z * Z / (4 * n * n))
    middle = p + Z * Z / (2 * n)
    return (F.when(n == 0, "none").when((middle - half) / (1 + Z * Z / n) > 0.5, "block")
            .when((middle + half) / (1 + Z * Z / n) < 0.5, "allow").otherwise("mixed"))


def merged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``template`` after similar first-level branches are merged."""
    branch = F.regexp_extract("template", r"(?s)^(/[^/]*)", 1)
    below = F.expr("substring(template, length(branch) + 1)")
    rows = rows.withColumn("branch", branch).withColumn("below", below)
    subs = rows.groupBy("host", "branch", "below").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    stats = subs.groupBy("host", "branch").agg(
        F.count("*").alias("subs"), F.min("below").alias("low"), F.max("below").alias("high"),
        F.sum("b").alias("b"), F.sum("a").alias("a")).where("branch <> ''")
    kinds = stats.select("host", "branch", "subs", "low", "high", _class(F.col("b"), F.col("a")).alias("kind"))
    several = kinds.groupBy("host", "subs", "low", "high", "kind").agg(F.count("*").alias("branches")).where("branches > 1")
    alike = kinds.join(several, ["host", "subs", "low", "high", "kind"]).select("host", "branch", F.concat(F.lit("/*"), F.when(F.col("kind") == "none", "").otherwise(F.concat(F.lit("{"), "kind", F.lit("}")))).alias("joint"))
    return rows.join(alike, ["host", "branch"], "left").withColumn(
        "template", F.concat(F.coalesce("joint", "branch"), "below")).drop("branch", "below", "joint")


def judge(pages: DataFrame, block: Sequence[str], allow: Sequence[str]) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parts = stored(parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*block, *allow])), "url-parts")
    blocked, allowed = F.col("rule").isin(list(block)), F.col("rule").isin(list(allow))
    of_rule = F.when(blocked, "block").when(allowed, "allow")
    paths = parts.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(blocked, F.lit(False))).alias("b"), F.count_if(F.coalesce(allowed, F.lit(False))).alias("a"))
    paths = stored(paths, "url-paths")
    rows = stored(merged(templates(paths)), "url-templates")
    total = paths.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    labelled = (total["b"] or 0) + (total["a"] or 0)
    share = total["b"] / labelled if labelled else 0.5
    purity = rows.groupBy("host", "template").agg(F.sum("b").alias("tb"), F.sum("a").alias("ta")).withColumn(
        "purity", (F.col("tb") + ALPHA * share) / (F.col("tb") + F.col("ta") + ALPHA))
    judged = rows.select("host", "path", "template").join(purity, ["host", "template"]).select(
        "host", "path", "template", "purity",
        F.when((F.col("tb") > 0) & (F.col("purity") >= REJECT_FROM), "block").otherwise("allow").alias("by_template"))
    return parts.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce(of_rule, "by_template").alias("verdict"), "template", "purity")
