"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.sources import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the links ``a, b``; comp is its least node.

    Every round each node takes the least label among itself and its
    neighbours, and then the label of its label, which shortens long chains.
    Labels are stored after each round, and the rounds end when no label
    changes. A node with any number of links is one row of an aggregate.
    """
    both = links.union(links.select("b", "a")).distinct()
    edges = materialize(both, "edges")
    labels = materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("comp")
        ),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("comp").alias("near"))
        )
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        step = materialize(step, "labels")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        after = materialize(
            step.join(jump, "comp").select("node", "old", F.col("beyond").alias("comp")), "labels"
        )
        labels = after.select("node", "comp")
        if after.where("old != comp").isEmpty():
            return labels
