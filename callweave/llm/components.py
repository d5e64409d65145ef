"""Connected components by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import cut


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) edges to (node, component): the lowest node of each component, for nodes that have an edge.

    Each round gives a node the lowest label among its own and its neighbours', then the label of
    that label, so chains halve per round; partial minima are combined before the shuffle, so a hub
    of any degree is no hot task. Rounds run until nothing changes and are cut in the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("at"), F.col("component").alias("next"))
        new = cut(step.join(jump, step.component == jump["at"], "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
