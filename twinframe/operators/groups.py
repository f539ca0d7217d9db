"""The scan: features in, group members out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.operators.classify import classify
from twinframe.operators.filters import at_least
from twinframe.operators.similarity import borderline_components, similarity_components
from twinframe.operators.split import split_oversized
from twinframe.session import materialise


def find_groups(features: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``group_members``: duplicate groups, and borderline groups when they are asked for. Images with both sides
    below ``settings.min_dimension`` take no part."""
    features = at_least(features, settings.min_dimension)
    components = similarity_components(features, settings)
    split = split_oversized(components, features, settings).filter("group_id is not null")
    groups = classify(split, features, settings)
    if settings.ambiguous_detection and settings.ambiguous_threshold_factor > 1.0:
        groups = materialise(groups, "groups")
        groups = groups.unionByName(borderline_groups(features, groups, settings))
    return groups


def borderline_groups(features: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """Groups for manual review among images in no emitted group; members of groups without copies count as free."""
    free = features.join(groups.select("image_id"), "image_id", "left_anti")
    comps = borderline_components(free, settings)
    return comps.select(
        F.concat(F.lit("amb:"), "component").alias("group_id"), "image_id", F.lit("original").alias("role"),
        F.lit(False).alias("is_series"), F.lit(True).alias("is_ambiguous"), F.lit(False).alias("in_series"),
    )


def with_video_groups(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Image and video groups in one table, with ``media`` to tell them apart."""
    return images.withColumn("media", F.lit("image")).unionByName(videos.withColumn("media", F.lit("video")))


def display_ids(members: DataFrame, prefix: str = "g") -> DataFrame:
    """Short running numbers for a group table. One row per group is numbered, never the members."""
    groups = members.select("group_id").distinct()
    ordered = groups.repartitionByRange("group_id").withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition reaches this window.
    shift = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "shift", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    number = F.row_number().over(Window.partitionBy("part").orderBy("group_id"))
    numbered = ordered.withColumn("number", number).join(shift, "part").withColumn(
        "display_id", F.format_string(prefix + "%04d", F.col("number") + F.col("shift"))
    )
    return members.join(numbered.select("group_id", "display_id"), "group_id")


def solo_originals(features: DataFrame, members: DataFrame) -> DataFrame:
    """Scanned images in no group."""
    return features.join(members.select("image_id").distinct(), "image_id", "left_anti")

