"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import drop_table, store


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for each node of ``edges`` (a, b).

    In each turn every node goes to the smaller of itself and its smallest neighbour, chains of such
    steps are shortened, and edges move along until none joins two nodes. The smallest node of a
    component never moves. Stars take one turn, other graphs about the logarithm of their diameter.
    Neighbours are only ever reduced to their minimum, so a hub is no group of its own.
    """
    left = store(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            left.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        steps = both.groupBy("x").agg(F.min("y").alias("y"))
        steps = store(steps.select("x", F.least("x", "y").alias("to")), "steps")
        far = steps.select(F.col("x").alias("to"), F.col("to").alias("further"))
        moves = store(steps.join(far, "to").select("x", F.col("further").alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("x").alias("node"), F.col("to").alias("root"))
        else:
            moved = moves.select(F.col("x").alias("root"), "to")
            labels = store(
                labels.join(moved, "root", "left").select(
                    "node", F.coalesce("to", "root").alias("root")
                ),
                "labels",
            )
        ends = left.join(moves.select(F.col("x").alias("u"), F.col("to").alias("p")), "u")
        ends = ends.join(moves.select(F.col("x").alias("v"), F.col("to").alias("q")), "v")
        ends = ends.where("p <> q").select(
            F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")
        )
        before, left = left, store(ends.distinct(), "edges")
        drop_table(before)
        drop_table(steps)
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
