"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import durable
from ..plans.spread import spread_lookup


def connected_components(
    nodes: DataFrame, edges: DataFrame, *, group: list[str], node: str = "id"
) -> DataFrame:
    """Add ``component``: the smallest node of each component inside ``group``.

    ``edges`` has ``src`` and ``dst`` in both directions.  Every round takes the
    smallest component among the neighbours and then follows that component's own
    pointer, so chains shrink by halves; rounds go on until nothing changes, and each
    one is stored.  Neither a component nor a node of very many edges is one key: both
    are looked up in parts.
    """
    state = nodes.select(*group, F.col(node).alias("src"), F.col(node).alias("component"))
    links = durable(edges.select(*group, "src", "dst"))
    while True:
        there = state.select(*group, F.col("src").alias("dst"), F.col("component").alias("c"))
        best = (
            spread_lookup(links, there, [*group, "dst"], by=["src"], how="inner")
            .groupBy(*group, "src")
            .agg(F.min("c").alias("c"))
        )
        hooked = durable(
            state.join(best, [*group, "src"], "left").select(
                *group, "src", F.col("component").alias("before"), F.least("component", "c").alias("component")
            )
        )
        root = hooked.select(*group, F.col("src").alias("component"), F.col("component").alias("root"))
        state = durable(
            spread_lookup(hooked, root, [*group, "component"], by=["src"]).select(
                *group, "src", "before", F.least("component", "root").alias("component")
            )
        )
        if not state.filter("component < before").limit(1).count():
            return state.select(*group, F.col("src").alias(node), "component")
        state = state.select(*group, "src", "component")
