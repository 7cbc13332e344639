"""Connected components of a distributed edge table.

Labels start at the smallest neighbour; a round takes the smallest label among
the neighbours and then follows labels twice (pointer jumping), so that long
chains take a logarithmic number of rounds. A round ends with a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one comparable type -> (node, label): the smallest node
    of the component, for every node that has an edge to another node."""
    one = edges.where("a <> b").select("a", "b")
    links = stored(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        for _ in range(2):
            new = new.join(target, "label").select("node", "old", F.least("label", "next").alias("label"))
        labels = stored(new, "labels")
        changed = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
