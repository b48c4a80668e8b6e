"""Connected components of a link table, as DataFrame joins.

Each round hooks every label to its smallest neighbouring label and then
follows the hooks; labels are written to the shared folder after each round.
All reductions are minima with map-side combining, so a hub with very many
links is one row per task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of
    ``links`` (columns a, b)."""
    links = landed(links.select("a", "b").where("a <> b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = landed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component"))
                    .withColumnRenamed("a", "node"), "labels")
    for _ in range(MAX_ROUNDS):
        # links between labels
        edges = (links.join(labels.withColumnRenamed("node", "a").withColumnRenamed("component", "x"), "a")
                 .join(labels.withColumnRenamed("node", "b").withColumnRenamed("component", "y"), "b")
                 .where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")))
        # a first-round label may itself hang on a smaller one
        hang = labels.where("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y"))
        hooks = landed(edges.unionByName(hang).groupBy("x").agg(F.min("y").alias("y")), "hooks")
        for _ in range(2):
            nxt = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            hooks = hooks.join(nxt, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        new = labels.join(hooks.withColumnRenamed("x", "component"), "component", "left").select(
            "node", F.coalesce("y", "component").alias("component"), F.col("component").alias("was"))
        new = landed(new, "labels")
        changed = bool(new.where("component <> was").take(1))
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
