"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut, release


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (a, b).

    Each round takes the smallest label around a node, then the label of that label (pointer jumping), so that long
    chains shorten by half; a round ends in a written table. Only a count comes to the driver.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).filter("u <> v").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("l")).select("node", F.least("node", "l").alias("root")))
    held = labels
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(near.join(far, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        release(held)
        held = step
        if step.filter("old <> root").isEmpty():
            release(both)
            return step.select("node", "root")
        labels = step.select("node", "root")
