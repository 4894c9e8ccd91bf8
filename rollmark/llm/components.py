"""Connected components by minimum labels and pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of ``links`` (columns a, b; long) with the smallest node of their component.

    Every round takes the smallest label among a node and its neighbours, then jumps to the
    label's label twice, so labels travel much faster than one link a round. A round is written to the
    shared folder, which keeps the lineage short. Links in both directions, repeated links and
    links of a node to itself are allowed; an empty table gives an empty result.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = low.join(target, F.col("low") == F.col("at"), "left").select("node", "old", F.least("low", F.coalesce("next", "low")).alias("label"))
        fresh = stored(jumped)
        changed = fresh.where("label <> old").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
