"""Connected components of an edge table, as a loop of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesmith.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of the component.

    Each round hooks every node to its least neighbour if that is smaller, follows the hooks once
    more, and contracts the edges; a star is done after one. The driver only asks whether edges
    are left. Hot nodes are keys of aggregates, and of joins with one row a key on the other side.
    """
    left = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    labels = checkpointed(labels)
    while not left.isEmpty():
        up = checkpointed(left.groupBy(F.col("b").alias("at")).agg(F.min("a").alias("to")))
        again = up.select(F.col("at").alias("to"), F.col("to").alias("top"))
        up = checkpointed(up.join(again, "to", "left").select("at", F.coalesce("top", "to").alias("to")))
        labels = checkpointed(labels.join(up, labels["label"] == up["at"], "left").select("node", F.coalesce("to", "label").alias("label")))
        a = up.select(F.col("at").alias("a"), F.col("to").alias("_a"))
        b = up.select(F.col("at").alias("b"), F.col("to").alias("_b"))
        moved = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        left = checkpointed(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return labels
