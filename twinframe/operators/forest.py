"""Minimum spanning forests of weighted edge tables: the components under every limit of the weight at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.operators.components import connected_components
from twinframe.session import materialise


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` of a minimum spanning forest of ``edges (src long, dst long, weight int)``.

    Of all edges up to any weight, the forest's edges up to that weight connect exactly the same nodes, and they are
    fewer than the nodes. Borůvka's rounds: every component takes its lightest edge out (ties by the ends, so the order is
    total and no cycle arises), what is taken is contracted, and parallel edges keep the lightest. Components at least
    halve in each round. Minima combine map-side, so a hub of any degree is one row per task.
    """
    ordered = edges.filter("src <> dst").select(
        F.struct("weight", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).alias("e")).distinct()
    current = materialise(ordered.select(F.col("e.src").alias("a"), F.col("e.dst").alias("b"), "e"), "weighted")
    taken = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        best = both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.e").alias("e"))
        best = materialise(best, "lightest")
        taken.append(best.select("e.src", "e.dst", "e.weight").distinct())
        comps = materialise(connected_components(best.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "contracted")
        # Every end of an edge has taken one, so it is in a component.
        for end in ("a", "b"):
            names = comps.select(F.col("node").alias(end), F.col("component").alias(f"{end}_"))
            current = current.join(names, end).drop(end).withColumnRenamed(f"{end}_", end)
        current = current.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        current = materialise(current, "weighted")
    return reduce(DataFrame.union, taken) if taken else current.select("e.src", "e.dst", "e.weight")
