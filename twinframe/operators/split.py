"""Splitting of components larger than the cap around medoids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.config import Params, Settings
from twinframe.operators.blocks import near_of_scopes, placed_rows
from twinframe.operators.predicates import PairRule
from twinframe.operators.ranking import bit_totals, distance_to_all, running_sum
from twinframe.operators.similarity import (
    MOST_BLOCKED, PAIR_COLUMNS, collapse, near_between, node_cells, pair_linker, shape_bin, similarity_components,
)
from twinframe.session import materialise

FIRST_STEP = 64  # the least first step
LEAST_FACTOR, STEP_FACTOR = 2, 8
PAIRS_PER_NODE = 50


def split_oversized(components: DataFrame, features: DataFrame, settings: Settings, recheck_remainder: bool = False) -> DataFrame:
    """``(image_id, group_id)``: components within the cap as they are, larger ones split.

    The members of a component have a fixed order: total distance to all members (its medoid first), then
    ``image_id``. In that order the first member left becomes a centre and takes all members left that pass the pair
    rule against it, until no more than the cap are left; those form one group as they stand, or with
    ``recheck_remainder`` the connected groups they still make among themselves. Whoever ends up alone has a null
    ``group_id``, so every row of ``components`` comes back.

    The centres are the greedy maximal independent set of the pass graph in that order, and each other member joins the
    first centre it passes with. Of a prefix of the order, every member that is first among its undecided passing
    neighbours becomes a centre at once, its neighbours drop out, and so on; then the centres take their neighbours
    in all of what is left. The first prefix has so many members that all pairs in it stay in proportion to the component,
    and prefixes grow by a factor, so rounds grow with the logarithm of the component. Only members left are looked for, and
    dense parts vanish with the first centres, so near pairs of a whole component are never listed. Members meet in blocks
    of their component, or beyond ``MOST_BLOCKED`` nodes through the keys of the radius join; alike ones are one node, and
    no task holds a component.
    """
    plain = components.select("image_id", F.col("component").alias("group_id"))
    cap = settings.max_group_size
    if cap <= 0:
        return plain
    plain = materialise(plain, "components")
    sizes = plain.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sizes.filter(F.col("n") > cap), "large")
    if large.isEmpty():
        return plain
    result = plain.join(large, "group_id", "left_anti").select("image_id", "group_id")
    members = plain.join(large, "group_id").join(features.select("image_id", *PAIR_COLUMNS), "image_id")
    row = F.struct(*PAIR_COLUMNS)
    # Copies pass with each other, but for rows that fail the rule against themselves: those stay apart.
    own = F.when(~PairRule(row, row, Params(settings)).similar, F.col("image_id"))
    members = materialise(members.withColumn("own", own), "oversized")
    nodes, membership = _ordered(members, large)
    assigned = _assigned(nodes, settings)
    named = _named(nodes, membership, assigned, cap)
    if recheck_remainder:
        named = materialise(named, "named")
        rest = named.filter("rest").select("image_id")
        # Files of different components never pass, so all remainders are linked in one run.
        linked = similarity_components(features.join(rest, "image_id", "left_semi"), settings)
        again = rest.join(linked, "image_id", "left").select("image_id", F.col("component").alias("group_id"))
        return result.unionByName(named.filter("not rest").drop("rest")).unionByName(again)
    return result.unionByName(named.drop("rest"))


def _ordered(members: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` numbered by component and then by their order in it, and ``membership(image_id, node_id)``."""
    found, membership = collapse(members, ["group_id", "own", *PAIR_COLUMNS])
    totals = members.groupBy("group_id").agg(*bit_totals(F.col("phash"))).join(large, "group_id")
    scored = found.join(totals, "group_id").withColumn("total", distance_to_all("phash", "n"))
    scored = scored.select("node_id", "group_id", "n", "total", "image_id", "copies", F.lit(1).alias("one"), *PAIR_COLUMNS)
    placed = materialise(running_sum(scored, ["group_id", "total", "image_id"], "one", "place"), "ordered")
    membership = membership.join(placed.select("node_id", "place"), "node_id").select("image_id", F.col("place").alias("node_id"))
    return placed.drop("node_id", "total", "one").withColumnRenamed("place", "node_id"), membership


def _assigned(nodes: DataFrame, settings: Settings) -> DataFrame:
    """``(node_id, centre)`` of all nodes that some centre takes, centres included, until each component has at most the
    cap left."""
    cap = settings.max_group_size
    linker = pair_linker(nodes, settings)
    n = nodes.count()
    if n <= MOST_BLOCKED:
        cells = placed_rows(nodes.withColumn("bin", shape_bin([settings])), n, "group_id", "n")
    else:
        cells = node_cells(nodes, settings, "group_id")
    cells = materialise(cells, "cells")
    open_ = materialise(nodes.select("node_id", "group_id", "copies"), "open")
    steps, assigned = None, []
    while True:
        steps = materialise(_steps(open_, steps), "steps")
        prefix = materialise(_prefix(open_, steps), "prefix")
        within = _meetings(prefix, prefix, cells, settings, n).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        within = materialise(within.distinct(), "met")
        edges = materialise(linker.test(within), "passes")
        centres = materialise(_centres(prefix.select("node_id"), edges), "centres")
        passed = edges.join(centres.select(F.col("node_id").alias("src")), "src")
        more = prefix.count() < open_.count()
        if more:
            behind = materialise(open_.join(prefix.select("node_id"), "node_id", "left_anti"), "behind")
            passed = passed.unionByName(linker.test(_meetings(centres, behind, cells, settings, n).distinct()))
        taken = passed.groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("centre"))
        taken = taken.union(centres.select("node_id", F.col("node_id").alias("centre")))
        assigned.append(materialise(taken, "taken"))
        if not more:
            return reduce(DataFrame.union, assigned)
        rest = behind.join(assigned[-1].select("node_id"), "node_id", "left_anti")
        left = rest.groupBy("group_id").agg(F.sum("copies").alias("left")).filter(F.col("left") > cap)
        open_ = materialise(rest.join(left.select("group_id"), "group_id", "left_semi"), "open")
        if open_.isEmpty():
            return reduce(DataFrame.union, assigned)
        pairs = within.join(prefix.withColumnRenamed("node_id", "a"), "a").groupBy("group_id").agg(F.count(F.lit(1)).alias("pairs"))
        steps = steps.join(pairs, "group_id", "left")


def _steps(open_: DataFrame, last: DataFrame | None) -> DataFrame:
    """``(group_id, step, high)``: how many places of its order a component decides in this round, and where they end.

    All pairs of the first step stay within ``PAIRS_PER_NODE`` for each node left. Later steps grow as far as they would if
    near pairs grew with the square of the step, but by ``LEAST_FACTOR`` at least and ``STEP_FACTOR`` at most.
    """
    left = open_.groupBy("group_id").agg(F.min("node_id").alias("low"), F.count(F.lit(1)).alias("left"))
    budget = F.col("left") * PAIRS_PER_NODE
    if last is None:
        step = F.greatest(F.sqrt(budget * 2), F.lit(FIRST_STEP))
    else:
        left = left.join(last.select("group_id", F.col("step").alias("last"), "pairs"), "group_id")
        fits = F.coalesce(F.sqrt(budget / F.col("pairs")), F.lit(STEP_FACTOR))
        step = F.col("last") * F.least(F.greatest(fits, F.lit(LEAST_FACTOR)), F.lit(STEP_FACTOR))
    left = left.withColumn("step", F.floor(step).cast("long"))
    return left.select("group_id", "step", (F.col("low") + F.col("step")).alias("high"))


def _prefix(open_: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes of each component that this round decides."""
    return open_.join(steps, "group_id").filter(F.col("node_id") < F.col("high")).select("node_id", "group_id")


def _meetings(left: DataFrame, right: DataFrame, cells: DataFrame, settings: Settings, n: int) -> DataFrame:
    """``(a, b)``: nodes of both sides, of ``n`` in all, that are near by their blocks or share a pair of near cells."""
    key = lambda c: F.xxhash64(c)  # equal keys of unlike cells cost a test and nothing else
    lhs = cells.join(left.select("node_id"), "node_id", "left_semi")
    rhs = lhs if right is left else cells.join(right.select("node_id"), "node_id", "left_semi")
    here = left.count()
    sizes = here, here if right is left else right.count()
    if "home" in cells.columns:
        return near_of_scopes(lhs, rhs, settings, sizes, n)
    near = near_between(lhs, rhs, settings, sizes).select(key("u").alias("u"), key("v").alias("v"))
    lhs = lhs.select(F.col("node_id").alias("a"), key("cell").alias("u"))
    rhs = rhs.select(F.col("node_id").alias("b"), key("cell").alias("v"))
    return lhs.join(near, "u").join(rhs, "v").filter("a <> b").select("a", "b")


def _centres(prefix: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of ``prefix`` that pass with no centre before them, from the passing pairs ``(src < dst)``."""
    ends = lambda e, name: e.select(F.col(name).alias("node_id")).distinct()
    while not edges.isEmpty():
        # Nodes without an earlier neighbour left are centres; their neighbours are not.
        free = ends(edges, "src").join(ends(edges, "dst"), "node_id", "left_anti")
        beaten = materialise(ends(edges.join(free.withColumnRenamed("node_id", "src"), "src"), "dst"), "beaten")
        prefix = prefix.join(beaten, "node_id", "left_anti")
        for end in ("src", "dst"):
            edges = edges.join(beaten.withColumnRenamed("node_id", end), end, "left_anti")
        edges = materialise(edges.select("src", "dst"), "passes")
    return prefix


def _named(nodes: DataFrame, membership: DataFrame, assigned: DataFrame, cap: int) -> DataFrame:
    """``(image_id, group_id, rest)``: groups of the centres up to the point where no more than the cap are left, and the
    rest."""
    assigned = assigned.join(nodes.select("node_id", "group_id", "n", "copies"), "node_id")
    sizes = assigned.groupBy("group_id", "n", "centre").agg(F.sum("copies").alias("size"))
    # Centres are numbered by component, so what is gone within one is a difference of sums over all.
    gone = running_sum(sizes, "centre", "size", "upto")
    start = gone.groupBy("group_id").agg(F.min("upto").alias("start"))
    used = gone.join(start, "group_id").filter(F.col("n") - (F.col("upto") - F.col("start")) > cap)
    placed = assigned.select("node_id", "centre").join(used.select("centre"), "centre")
    every = nodes.select("node_id", "group_id").join(placed, "node_id", "left").join(membership, "node_id")
    every = materialise(every.select("image_id", "group_id", F.coalesce("centre", F.lit(-1)).alias("centre")), "placed")
    names = every.groupBy("group_id", "centre").agg(F.min("image_id").alias("name"), F.count(F.lit(1)).alias("size"))
    return every.join(names, ["group_id", "centre"]).select(
        "image_id", F.when(F.col("size") > 1, F.col("name")).alias("group_id"), (F.col("centre") == -1).alias("rest"))
