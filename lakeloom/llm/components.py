"""Connected components of a link table, by contraction.

Each round every vertex points at its smallest neighbour (or itself), pointers
are followed until they rest, and the links are rewritten between the resting
vertices; links inside one are gone. Rounds end when no link is left. A vertex
with many links costs one partially aggregated minimum and skew-splittable
joins; nothing is collected. Every round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import work_root


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest
    node of its component. Self-links and repeated links are fine."""
    work_root(links.sparkSession)  # names the checkpoint folder where the session has none
    links = links.select("a", "b").distinct().checkpoint()
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    labels = labels.checkpoint()
    links = links.where("a <> b")
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("v"), F.least("a", "b").alias("to")).checkpoint()
        while True:  # a pointer always leads to a smaller vertex, so the paths end
            ends = up.select(F.col("v").alias("to"), F.col("to").alias("next"))
            moved = up.join(ends, "to").select("v", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("went"))
            moved = moved.checkpoint()
            up = moved.select("v", "to")
            if moved.where("went").isEmpty():
                break
        labels = labels.join(up.withColumnRenamed("v", "label"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")).checkpoint()
        a, b = up.select(F.col("v").alias("a"), F.col("to").alias("x")), up.select(F.col("v").alias("b"), F.col("to").alias("y"))
        links = links.join(a, "a").join(b, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
    return labels
