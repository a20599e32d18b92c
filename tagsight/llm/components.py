"""Connected components of a table of links, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b): label is the smallest id that can be reached.

    Every round gives a node the smallest label of its neighbours and then that label's own label, until nothing
    changes; the number of rounds follows the logarithm of the longest path. Minima are combined before they move, so
    a node with very many links is no hot key.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "near").alias("next"), "label")
        closer = durable(closer)
        jumped = closer.join(closer.select(F.col("id").alias("next"), F.col("next").alias("further")), "next", "left")
        after = durable(jumped.select("id", F.least("next", F.coalesce("further", "next")).alias("new"), "label"))
        changed = not after.where("new < label").isEmpty()
        labels = after.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
