"""Collision-free target names.

The claims of one target are a family: they take the target, ``stem_1``, ``stem_2`` and so on. A name belongs to two families
at most, its own and that of the name without its number, so families form a forest (``a`` above ``a_1`` above ``a_1_1``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.paths import file_name, parent_dir
from twinframe.operators.ranking import rank_in_large_groups
from twinframe.session import materialise


def numbered(target: Column, k: Column) -> Column:
    """``dir/stem_k.ext``; number 0 is the target itself."""
    name = file_name(target)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    renamed = F.concat(parent_dir(target), F.lit("/"), stem, F.lit("_"), k.cast("string"), suffix)
    return F.when(k == 0, target).otherwise(renamed)


def _families(names: DataFrame) -> DataFrame:
    """Every ``(target, k)`` a taken name stands for: itself, and ``stem_k`` of the name without its number."""
    name = file_name(F.col("name"))
    number = F.regexp_extract(name, r"^.+_([1-9][0-9]{0,17})(\.[^.]+)?$", 1)
    base = F.concat(
        parent_dir(F.col("name")), F.lit("/"), F.regexp_extract(name, r"^(.+)_[1-9][0-9]{0,17}(\.[^.]+)?$", 1),
        F.regexp_extract(name, r"^.+_[1-9][0-9]{0,17}(\.[^.]+)?$", 1),
    )
    own = names.select(F.col("name").alias("target"), F.lit(0).cast("long").alias("k"))
    return own.union(names.filter(number != "").select(base, number.cast("long")))


def assign_targets(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """Give each claim ``(id, target, phase)`` the first free name: adds ``final`` and ``renamed``.

    The result is what claiming one by one in the order ``(phase, id)`` would give, with ``existing(path)`` taken
    from the start. A target that one claim wants, and that shares no name with another family or an existing file, is
    given as it is. In the other families the claims take the numbers in order, skipping those that are taken; the
    name of a child family is taken for its parent if the child's first claim comes before the parent's claim that
    reaches its number. Ranks come from range partitions, so a target wanted by a third of all files is no single task.
    """
    claims = claims.withColumn("order", F.struct("phase", "id"))
    families = claims.groupBy("target").agg(F.count(F.lit(1)).alias("claims"), F.min("order").alias("first"))
    families = materialise(families, "families")
    taken = _families(existing.select(F.col("path").alias("name"))).distinct()
    blocked = materialise(taken.join(families.select("target"), "target", "left_semi"), "blocked")
    children = _families(families.select(F.col("target").alias("name"))).filter("k > 0").withColumnRenamed("target", "parent")
    children = children.withColumn("target", numbered(F.col("parent"), F.col("k")))
    children = children.join(families.select(F.col("target").alias("parent")), "parent", "left_semi").join(families.select("target", "first"), "target")
    children = materialise(children.select("target", "first", "parent", "k"), "children")
    contested = families.filter("claims > 1").select("target").union(blocked.select("target")).union(
        children.select("target")).union(children.select("parent")).distinct()
    contested = materialise(contested, "contested")
    alone = claims.join(contested, "target", "left_anti").select("*", F.col("target").alias("final"), F.lit(False).alias("renamed"))
    ranked = rank_in_large_groups(claims.join(contested, "target"), "target", "order")
    ranked = materialise(ranked.withColumnRenamed("rank", "position"), "claims")
    blocked = blocked.unionByName(_passed_on(ranked, blocked, children))
    held = _fill(ranked, materialise(blocked, "blocked")).withColumn("renamed", F.col("k") > 0)
    return held.drop("order", "k", "position").unionByName(alone.drop("order"))


def _passed_on(ranked: DataFrame, blocked: DataFrame, children: DataFrame) -> DataFrame:
    """``(target, k)``: numbers that a child family takes from its parent, and names that a parent takes from a child.

    A parent's claim reaches number ``k`` as the one with rank ``k`` less the numbers taken before. The child has the
    name by then if that rank is not below the number of claims before the child's first. What is taken before depends
    on the other children and on whether the parent's own name went to its parent; a stream over the numbers of a family
    settles both cases, and the case that holds follows down the forest, doubling the steps.
    """
    # Names that exist are taken for both.
    children = children.join(blocked.filter("k = 0").select("target"), "target", "left_anti")
    children = materialise(children, "children")
    if children.isEmpty():
        return blocked.limit(0)
    rank = lambda df, order, name: rank_in_large_groups(df, "parent", order).withColumnRenamed("rank", name)
    # Claims of the parent before the child's first claim.
    both = ranked.select(F.col("target").alias("parent"), "order", F.lit(None).cast("string").alias("target")).join(
        children.select("parent").distinct(), "parent", "left_semi").unionByName(
        children.select("parent", F.col("first").alias("order"), "target"))
    both = rank(both, "order", "among_all").filter("target is not null").select("parent", "target", "order", "among_all")
    before = rank(both, "order", "among_children").select("target", (F.col("among_all") - F.col("among_children")).alias("earlier"))
    # Numbers of the parent that exist below the child's.
    spots = blocked.select(F.col("target").alias("parent"), "k", F.lit(None).cast("string").alias("target")).join(
        children.select("parent").distinct(), "parent", "left_semi").unionByName(children.select("parent", "k", "target"))
    spots = rank(spots, "k", "among_all").filter("target is not null").select("parent", "target", "k", "among_all")
    spots = rank(spots, "k", "among_children").withColumn("gone", F.col("among_all") - F.col("among_children"))
    rows = spots.select("parent", "target", "k", "gone").join(before, "target").select("parent", "target", "k", "gone", "earlier")

    def decide(batches):
        parent, passed = None, [0, 0]
        for b in batches:
            lost: tuple[list, list] = ([], [])
            for name, k, gone, earlier in zip(*(b.column(c).to_pylist() for c in ("parent", "k", "gone", "earlier"))):
                if name != parent:
                    parent, passed = name, [0, 0]
                for case in (0, 1):
                    to_child = k - gone - case - passed[case] >= earlier
                    passed[case] += to_child
                    lost[case].append(not to_child)
            yield pa.RecordBatch.from_arrays(
                [b.column("parent"), b.column("target"), b.column("k"), pa.array(lost[0], pa.bool_()), pa.array(lost[1], pa.bool_())],
                names=["parent", "target", "k", "lost", "lost_after"])

    decided = rows.repartition("parent").sortWithinPartitions("parent", "k").mapInArrow(
        decide, "parent string, target string, k long, lost boolean, lost_after boolean")
    decided = materialise(decided, "decided")

    # ``lost`` holds if the name of the family above stayed with it, ``lost_after`` if that went to its own parent.
    state = decided.select("target", F.col("parent").alias("above"), "lost", "lost_after")
    while True:
        up = state.select(F.col("target").alias("above"), F.col("above").alias("next"), F.col("lost").alias("l0"), F.col("lost_after").alias("l1"))
        joined = state.join(up, "above", "left")
        pick = lambda case: F.when(F.col(case).isNull(), F.col("lost" if case == "l0" else "lost_after")).when(F.col(case), F.col("lost_after")).otherwise(F.col("lost"))
        more = joined.select("target", F.col("next").alias("above"), pick("l0").alias("lost"), pick("l1").alias("lost_after"), F.col("next").isNull().alias("top"))
        # Families without one above keep their case: their name never went up.
        state = materialise(more.withColumn("above", F.coalesce("above", F.lit(""))).drop("top"), "cases")
        if state.filter(F.col("above") != "").isEmpty():
            break
    fate = state.select("target", "lost")
    of_parent = fate.select(F.col("target").alias("parent"), F.col("lost").alias("parent_lost"))
    final = decided.join(of_parent, "parent", "left").withColumn(
        "gone_up", F.when(F.coalesce("parent_lost", F.lit(False)), F.col("lost_after")).otherwise(F.col("lost")))
    return final.select(
        F.when(F.col("gone_up"), F.col("target")).otherwise(F.col("parent")).alias("target"),
        F.when(F.col("gone_up"), F.lit(0).cast("long")).otherwise(F.col("k")).alias("k"))


def _fill(ranked: DataFrame, blocked: DataFrame) -> DataFrame:
    """Each claim with the number it gets: its rank among the numbers that are not blocked."""
    if blocked.isEmpty():
        return ranked.withColumn("k", F.col("position")).withColumn("final", numbered(F.col("target"), F.col("k")))
    # The i-th blocked number b stands before every claim with rank >= b - i.
    places = rank_in_large_groups(blocked, "target", "k").select(
        "target", F.struct((F.col("k") - F.col("rank")).alias("at"), F.lit(0).alias("kind"), "k").alias("spot")
    )
    rows = ranked.select(
        "target", F.struct(F.col("position").alias("at"), F.lit(1).alias("kind"), F.col("position").alias("k"))
        .alias("spot")
    ).union(places)
    merged = rank_in_large_groups(rows, "target", "spot").filter("spot.kind = 1")
    numbers = merged.select("target", F.col("spot.at").alias("position"), F.col("rank").alias("k"))
    return ranked.join(numbers, ["target", "position"]).withColumn("final", numbered(F.col("target"), F.col("k")))
