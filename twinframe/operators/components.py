"""Connected components of a long-keyed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.session import materialise

MAX_ROUNDS = 60


def _attach_minimum(edges: DataFrame, by: str) -> DataFrame:
    """Each edge with the smallest neighbour of its ``by`` end. The minimum combines map-side, and the join back
    meets one row per key, so a hub of any degree is split by the skew join and never gathered."""
    lows = edges.groupBy(F.col(by).alias("hub")).agg(F.min("dst" if by == "src" else "src").alias("low"))
    return edges.join(lows, F.col(by) == F.col("hub"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    with_low = _attach_minimum(both, "src")
    return with_low.filter("dst > src").select(F.col("dst").alias("src"), F.least("low", "src").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    lows = edges.groupBy("src").agg(F.min("dst").alias("low"))
    linked = edges.join(lows, "src").filter("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return linked.union(lows.select("src", F.col("low").alias("dst"))).filter("src > dst").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node points at one centre, and no centre points anywhere: nothing is left to do."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(
        edges.select("dst", F.lit(0)).distinct()
    )
    roles = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n"))
    return roles.filter("out > 1 or (out = 1 and n > 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that has an edge; a component is named by its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is a few aggregates and joins
    and ends in a written table; the loop stops when every component is a star around its smallest node. Hitting
    the round limit raises: a partial answer is never returned.
    """
    current = edges.filter("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).distinct()
    current = materialise(current, "edges")
    for _ in range(MAX_ROUNDS):
        if _is_star_forest(current):
            return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
                current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            )
        current = materialise(_small_star(_large_star(current)), "star")
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def extend_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` after further ``edges (src, dst)``, given the components without them.

    Ends are mapped to the components they are in, and only that contracted graph is solved: edges inside a component
    vanish, so the work follows what is new. Nodes without a component count as their own.
    """
    for end in ("src", "dst"):
        names = components.select(F.col("node").alias(end), F.col("component").alias("known"))
        edges = edges.join(names, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    merged = connected_components(edges.select("src", "dst"))
    merged = materialise(merged, "merged")
    if merged.isEmpty():
        return components
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    known = components.join(renamed, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = merged.join(components.select("node"), "node", "left_anti").select("node", "component")
    return materialise(known.union(fresh), "components")
