"""Connected components of links as distributed tables, by contraction; nothing is gathered on the driver.

Each round every id with smaller neighbours hooks to the least of them, which makes a forest of one link an id. Trees are
flattened by pointer jumping, links inside a tree go, the others are drawn between roots, each once. So a round exchanges
only what still joins two trees, and links to a hub that its members hook to are gone before they are dealt by hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common

#: Copies of a small mapping that rows of a hot label are dealt to.
SALTS = 8


def relabelled(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """df with col replaced by mapping's up (_id, up) where it has one. Rows of one label are dealt to SALTS tasks."""
    m = mapping.select(F.col("_id").alias("_from"), F.col("up").alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    j = dealt.join(m, (dealt[col] == m["_from"]) & (dealt["_salt"] == m["_salt"]), "left")
    return j.select(*[F.coalesce("_to", col).alias(c) if c == col else dealt[c] for c in df.columns])


def flattened(forest: DataFrame, old: list[str]) -> DataFrame:
    """_id, up: each id's root in forest (_id, up). Replaced tables' paths are added to old."""
    while True:
        # most ids point at roots; only the few that do not are joined on
        inner, path = common.materialize(forest.select(F.col("up").alias("_id")).distinct().join(forest, "_id"), "inner")
        old.append(path)
        if inner.isEmpty():
            return forest
        forest, path = common.materialize(relabelled(forest, "up", inner), "forest")
        old.append(path)


def components(links: DataFrame) -> DataFrame:
    """_id, component (the smallest id reachable) of every id in links (a, b, which differ; any direction, repeats do no harm)."""
    spark, old, levels = links.sparkSession, [], []
    between, path = common.materialize(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    old.append(path)
    while not between.isEmpty():
        forest, path = common.materialize(between.groupBy(F.col("b").alias("_id")).agg(F.min("a").alias("up")), "forest")
        old.append(path)
        roots = flattened(forest, old)
        levels.append(roots)
        half = between.join(roots, between["b"] == roots["_id"]).filter("a != up").select("a", F.col("up").alias("b")).distinct()
        both = relabelled(half, "a", roots).filter("a != b")
        between, path = common.materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        old.append(path)
    if not levels:
        return spark.createDataFrame([], "_id long, component long")
    of = levels.pop()
    while levels:  # from the last round to the first: a root's own root in later rounds
        below = levels.pop()
        of = relabelled(below, "up", of).union(of)
    ids = of.select("_id", F.col("up").alias("component"))
    out, _ = common.materialize(ids.union(ids.select(F.col("component").alias("_id"), "component").distinct()), "labels")
    common.discard(spark, *old)
    return out
