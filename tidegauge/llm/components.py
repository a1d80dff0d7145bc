"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, label for every node of the edges ``a``, ``b``; the label is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so that long chains close in a logarithmic number of rounds. Rounds
    end when none changes a label; the lineage is cut in each. Nothing but counts
    reaches the driver, and no node's neighbours are gathered.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        closer = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = closer.join(above, "label", "left").select("node", "old", F.coalesce(F.least("label", "next"), "label").alias("label"))
        step = cut(step)
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {most_rounds} rounds")
