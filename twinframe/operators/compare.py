"""Comparing two sources: what of the second is already in the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.operators.ranking import keep_order


def union_sides(main: DataFrame, check: DataFrame) -> DataFrame:
    """Both feature tables as one, with the ``side`` each row is from."""
    return main.withColumn("side", F.lit("main")).unionByName(check.withColumn("side", F.lit("check")))


def compare_roles(groups: DataFrame, features: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """New roles for groups found over both sides; ``features`` holds ``side``.

    With members on both sides, main files stay and check files can go (``match = 'cross'``). With check files
    only, the first stays (``match = 'check'``); groups of main files only are dropped. First is: originals
    before copies, then, where formats are kept apart, the format met first and bursts before single shots, then
    keep order.
    """
    columns = ["image_id", "side", "ext", "is_raw", "width", "height", "file_size", "mtime", "exif_date", "name"]
    rows = groups.join(features.select(*columns), "image_id").withColumn("k", keep_order(settings))
    sides = rows.groupBy("group_id").agg(
        F.max(F.col("side") == "main").alias("in_main"), F.count_if(F.col("side") == "check").alias("n_check")
    )
    rows = rows.join(sides.filter("n_check > 0 and (in_main or n_check > 1)"), "group_id")
    later = F.when(F.col("role") == "original", 0).otherwise(1)
    if settings.keep_all_formats:
        # Formats follow each other in the order of their best member; inside one, bursts come first.
        lead = rows.groupBy("group_id", "ext").agg(F.min("k").alias("format_lead"))
        rows = rows.join(lead, ["group_id", "ext"])
        burst = F.when(F.col("in_series"), 0).otherwise(1)
        order = F.struct(later.alias("r"), F.col("format_lead"), burst.alias("b"), F.col("k"))
    else:
        order = F.struct(later.alias("r"), F.col("k"))
    rows = rows.withColumn("order", order)
    firsts = rows.filter(~F.col("in_main")).groupBy("group_id").agg(F.min("order").alias("first"))
    rows = rows.join(firsts, "group_id", "left")
    kept = F.when(F.col("in_main"), F.col("side") == "main").otherwise(F.col("order") == F.col("first"))
    return rows.select(
        "group_id", "image_id", F.when(kept, "original").otherwise("preview").alias("role"),
        F.when(F.col("in_main"), "cross").otherwise("check").alias("match"), "is_series", "is_ambiguous",
    )


def compare_summary(roles: DataFrame) -> DataFrame:
    """One row: groups and removable files, across the sides and within the check side."""
    dup = F.col("role") == "preview"
    cross, check = F.col("match") == "cross", F.col("match") == "check"
    return roles.agg(
        F.count_distinct(F.when(cross, F.col("group_id"))).alias("cross_groups"),
        F.count_if(cross & dup).alias("cross_dups"),
        F.count_distinct(F.when(check, F.col("group_id"))).alias("check_groups"),
        F.count_if(check & dup).alias("check_dups"),
        F.count_if(dup).alias("total_dups"),
    )
