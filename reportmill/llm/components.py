"""Connected components of an edge table, as DataFrame iterations with written tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the smallest label around every node, then jumps to the
    label's own label, so the number of rounds follows the logarithm of the
    diameter.  Minima are combined before they are shuffled; a hub is only a
    join key, which adaptive execution splits.  An empty table gives an empty
    result; self links and repeated edges do no harm; rows with a null end are
    left out.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = materialize(labels, "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "comp")
        low = near.union(labels).groupBy("node").agg(F.min("comp").alias("comp"))
        low = materialize(low, "near")
        jump = low.alias("l").join(low.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp")
        fresh = materialize(jump.select("node", F.least("comp", "up").alias("comp")), "labels")
        moved = fresh.join(labels.withColumnRenamed("comp", "was"), "node").where("comp <> was").limit(1).count()
        discard(low)
        discard(labels)
        labels = fresh
        if not moved:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
