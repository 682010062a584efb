"""Connected components of a graph kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` ``(a, b)``; a component is named by its least node.

    In a round every node points to the neighbour (or itself) of the least
    hash; pointers are followed, edges are drawn between the nodes that they
    end at, and those inside one node vanish. Hashes differ by round, so each
    round leaves a fraction of the nodes whatever the shape. Tables are written
    each round: plans stay flat, and a lost executor costs no more than a round.
    Self-loops, repeated and reversed edges change nothing; null ends are left out.
    """
    spark = edges.sparkSession
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    left = written(both.distinct(), "edges")
    labels: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        order = lambda c, seed=turn: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("v"))
        sides = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        closed = sides.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["v"].alias("to"))
        points = written(closed.select(F.col("a").alias("v"), "to"), "pointers")
        for _ in range(2):
            further = points.select(F.col("v").alias("to"), F.col("to").alias("next"))
            points = points.join(further, "to").select("v", F.col("next").alias("to"))
        points = written(points, "pointers")
        if labels is None:
            labels = points.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            moved = points.select(F.col("v").alias("root"), "to")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "labels")
        at = lambda c: points.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}"))
        drawn = left.join(at("a"), "a").join(at("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = written(drawn.where("a <> b").distinct(), "edges")
        turn += 1
    if labels is None:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}")
    least = written(labels.groupBy("root").agg(F.min("node").alias("component")), "components")
    return labels.join(least, "root").select("node", "component")
