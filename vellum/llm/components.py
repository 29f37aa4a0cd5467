"""Connected components of a table of links, by label propagation with shortcuts; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.durable import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id it is linked to, directly or not."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")))
    if labels.isEmpty():
        return labels
    edges = checkpointed(both.distinct())
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # a shortcut: the label of the label
        hop = step.select(F.col("id").alias("component"), F.col("component").alias("hop"))
        step = checkpointed(step.join(hop, "component", "left").select("id", "was", F.least("component", "hop").alias("component")))
        changed = not step.where("component < was").isEmpty()
        labels = step.select("id", "component")
        if not changed:
            return labels
