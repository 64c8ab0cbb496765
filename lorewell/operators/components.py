"""Connected components of small link tables: the smallest label over links until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """_id, component of every id in links (a, b). Lineage is cut by checkpoints in the session's shared folder."""
    from lorewell.sources.scratch import checkpointed

    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("_id"), F.least("a", "low").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["_id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["_id"] == near["a"]).select("_id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = step.select(F.col("_id").alias("up"), F.col("component").alias("over"))
        moved = checkpointed(step.join(up, step["component"] == up["up"]).select("_id", F.col("over").alias("component"), "was"))
        labels = moved.select("_id", "component")
        if moved.filter("component != was").isEmpty():
            return labels
