"""Review of groups: decisions, manual groups, and what they teach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions.hashing import ROTATIONS, rotation_distance
from twinframe.functions.paths import in_folder


def with_decisions(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``group_selected`` and ``selected``; whatever was not decided counts as selected.

    A decision with a null ``image_id`` is about the whole group.
    """
    whole = decisions.filter("image_id is null").select("group_id", F.col("selected").alias("group_selected"))
    single = decisions.filter("image_id is not null").select("group_id", "image_id", "selected")
    return (
        members.join(whole, "group_id", "left")
        .join(single, ["group_id", "image_id"], "left")
        .withColumns({
            "group_selected": F.coalesce("group_selected", F.lit(True)),
            "selected": F.coalesce("selected", F.lit(True)),
        })
    )


def chosen_for_trash(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Copies in selected groups that are selected themselves."""
    return with_decisions(members, decisions).filter("role = 'preview' and group_selected and selected").select(
        "group_id", "image_id"
    )


def groups_with_deselected(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups in which a copy was deselected."""
    return with_decisions(members, decisions).filter("role = 'preview' and not selected").select(
        "group_id"
    ).distinct()


def false_positive_distances(members: DataFrame, decisions: DataFrame, features: DataFrame) -> DataFrame:
    """Distances of each deselected copy to the originals of its flagged group.

    ``decisions`` flag a group by deselecting a copy in it. Originals are met once per distinct set of hashes, and
    each deselected copy keeps its nearest distance and the number of originals it was compared with.
    """
    hashes = ["phash", *ROTATIONS]
    rows = with_decisions(members, decisions).join(features.select("image_id", *hashes), "image_id")
    wrong = rows.filter("role = 'preview' and not selected").groupBy("group_id", *hashes).agg(
        F.count(F.lit(1)).alias("copies")
    )
    right = rows.filter("role = 'original'").groupBy("group_id", *hashes).agg(F.count(F.lit(1)).alias("originals"))
    a = wrong.select("group_id", "copies", F.struct(*hashes).alias("a"))
    b = right.select("group_id", "originals", F.struct(*hashes).alias("b"))
    dist = rotation_distance(F.col("a"), F.col("b"))
    return a.join(b, "group_id").groupBy("group_id", dist.alias("distance")).agg(
        F.sum(F.col("copies") * F.col("originals")).alias("pairs")
    )


def suggested_threshold(distances: DataFrame, current: int) -> DataFrame:
    """The smallest false-positive distance and, when it is below the current threshold, the advice drawn from it."""
    low = distances.agg(F.min("distance").alias("min_distance"))
    advice = F.greatest(F.lit(1), F.col("min_distance") - 1)
    return low.withColumn("suggested", F.when(advice < current, advice))


def applied_state(members: DataFrame, decisions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per group: ``none``, ``partial`` or ``full``, from copies already moved against copies selected."""
    moved = manifest.filter("status = 'moved'").select(F.col("from_path").alias("image_id")).distinct()
    rows = with_decisions(members.filter("role = 'preview'"), decisions).join(
        moved.withColumn("moved", F.lit(1)), "image_id", "left"
    )
    counts = rows.groupBy("group_id").agg(
        F.count("moved").alias("moved"), F.count_if("selected").alias("chosen")
    )
    every = members.select("group_id").distinct().join(counts, "group_id", "left").na.fill(0)
    state = (
        F.when((F.col("moved") > 0) & (F.col("moved") >= F.col("chosen")) & (F.col("chosen") > 0), "full")
        .when(F.col("moved") > 0, "partial")
        .otherwise("none")
    )
    return every.withColumn("state", state)


def decisions_to_ground_truth(
    members: DataFrame, decisions: DataFrame, manual: DataFrame | None = None, solos: DataFrame | None = None
) -> DataFrame:
    """``ground_truth`` from a review: confirmed groups, rejected groups, left-out members, manual groups, solos.

    A confirmed group with one confirmed member makes that member a single. Only groups with a decision count.
    """
    reviewed = decisions.select("group_id").distinct()
    rows = with_decisions(members.join(reviewed, "group_id", "left_semi"), decisions)
    confirmed = rows.groupBy("group_id").agg(F.count_if("selected").alias("confirmed"))
    rows = rows.join(confirmed, "group_id")
    kind = (
        F.when(~F.col("group_selected"), "negatives")
        .when(F.col("selected") & (F.col("confirmed") >= 2), "groups")
        .otherwise("singles")
    )
    out = rows.select(kind.alias("kind"), F.col("group_id").alias("label"), F.col("image_id").alias("path"))
    out = out.withColumn("label", F.when(F.col("kind") != "singles", F.col("label")))
    if manual is not None:
        sizes = manual.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
        out = out.union(
            manual.join(sizes, "group_id").select(
                F.lit("groups"), F.concat(F.lit("manual_"), "group_id"), F.col("image_id")
            )
        )
    if solos is not None:
        out = out.union(solos.select(F.lit("singles"), F.lit(None).cast("string"), F.col("image_id")))
    return out.distinct()


def create_manual_group(manual: DataFrame, chosen: DataFrame, group_id: str) -> DataFrame:
    """Adds one group of chosen images. Fewer than two make no group."""
    many = chosen.agg(F.count_distinct("image_id").alias("n")).filter("n >= 2")
    new = chosen.select(F.lit(group_id).alias("group_id"), "image_id").distinct().join(many.select(F.lit(1)))
    return manual.unionByName(new.select("group_id", "image_id"))


def remove_manual_members(manual: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manual groups left, freed images)`` after taking members out; a group under two dissolves."""
    left = manual.join(gone, ["group_id", "image_id"], "left_anti")
    many = left.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("group_id")
    kept = left.join(many, "group_id", "left_semi")
    freed = manual.select("image_id").join(kept.select("image_id"), "image_id", "left_anti").distinct()
    return kept, freed


def remove_manual_groups(manual: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(manual groups left, freed images)`` after removing whole groups."""
    kept = manual.join(gone, "group_id", "left_anti")
    freed = manual.join(gone, "group_id", "left_semi").select("image_id").distinct()
    return kept, freed


def groups_in_folder(members: DataFrame, folder: str) -> DataFrame:
    """Members of every group that touches a folder."""
    touched = members.filter(in_folder(F.col("image_id"), F.lit(folder))).select("group_id").distinct()
    return members.join(touched, "group_id", "left_semi")
