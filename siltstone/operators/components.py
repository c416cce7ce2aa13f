"""Connected components over an edge table, in rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.skew import hot_keys, lookup_join
from siltstone.session import stage, unstage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    Each round hooks every node to the smallest label around it and then
    shortcuts label chains, so the number of rounds grows with the logarithm of
    a component's diameter. Minimum labels combine before the shuffle and hub
    nodes go through :func:`lookup_join`, so a hub that touches a third of all
    edges does not end in one task. NULL ends and self loops only add their
    node; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = stage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "cc-labels")
    hubs = hot_keys(both, "u")
    for _ in range(max_rounds):
        near = (
            lookup_join(both.withColumnRenamed("u", "node"), labels, "node", hot=hubs)
            .groupBy(F.col("v").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = (
            labels.join(near, "node", "left")
            .select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        )
        # every label is itself a node: hook the old root to the lower label too, then follow one step
        roots = hooked.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("root_low"))
        best = hooked.join(roots, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("low", F.coalesce("root_low", "low")).alias("low")
        )
        best = stage(best, "cc-best")
        step = best.select(F.col("node").alias("low"), F.col("low").alias("jump"))
        moved = stage(
            lookup_join(best, step, "low", "left").select(
                "node", "old", F.least("low", F.coalesce("jump", "low")).alias("label")
            ),
            "cc-labels",
        )
        unstage(best)
        unstage(labels)
        labels = moved.select("node", "label")
        if moved.where("label <> old").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
