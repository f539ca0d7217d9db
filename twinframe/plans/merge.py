"""Merging several folders into one main folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions.paths import file_name, in_folder, parent_dir
from twinframe.operators.folders import source_root
from twinframe.operators.naming import assign_targets
from twinframe.operators.ranking import epoch
from twinframe.session import materialise


def group_originals(members: DataFrame, features: DataFrame, main: str, strategy: str = "pixels") -> DataFrame:
    """``(group_id, image_id)`` of the files a merge keeps: a member already in main first, else the largest or
    the oldest. Where a group mixes RAW and other formats, one of each."""
    facts = features.select("image_id", "is_raw", "width", "height", "mtime")
    rows = members.select("group_id", "image_id").join(facts, "image_id")
    value = epoch(F.col("mtime")) if strategy == "oldest" else -(F.col("width").cast("long") * F.col("height"))
    order = F.struct(
        F.when(in_folder(F.col("image_id"), F.lit(main)), 0).otherwise(1).alias("away"),
        F.when(in_folder(F.col("image_id"), F.lit(main)), F.lit(0)).otherwise(value).cast("double").alias("value"),
        "image_id",
    )
    best = rows.groupBy("group_id", "is_raw").agg(F.min(order).alias("k"))
    # A group of one format has one row here, a mixed one two.
    return best.select("group_id", F.col("k.image_id").alias("image_id"))


def merge_plan(
    members: DataFrame, features: DataFrame, main: str, sources: list[str], mode: str = "destructive",
    keep_subfolder: bool = False, strategy: str = "pixels",
) -> DataFrame:
    """``merge_ops``: ``(action, from_path, to_path, group_id, role, renamed, source_root, file_size)``.

    ``destructive`` moves originals and unique files to main and lists the duplicates; ``nondestructive`` copies
    them and lists each source's duplicates as its own trash (role ``source_trash``).
    """
    if mode not in ("destructive", "nondestructive"):
        raise ValueError(f"unknown mode {mode!r}")
    main = main.rstrip("/")
    inside = in_folder(F.col("image_id"), F.lit(main))
    facts = features.select("image_id", "file_size")
    kept = group_originals(members, features, main, strategy).withColumn("is_original", F.lit(True))
    grouped = members.select("group_id", "image_id").join(kept, ["group_id", "image_id"], "left")
    rows = facts.join(grouped, "image_id", "left").filter(~inside)
    copying = mode == "nondestructive"
    role = (
        F.when(F.col("group_id").isNull(), "unique")
        .when(F.col("is_original"), "original")
        .otherwise("source_trash" if copying else "duplicate")
    )
    rows = rows.withColumns({"role": role, "source_root": source_root(F.col("image_id"), sources)})
    rows = materialise(rows, "merge")
    moving = rows.filter(F.col("role").isin("unique", "original"))
    below = F.when(
        in_folder(F.col("image_id"), F.col("source_root")),
        F.substring(F.col("image_id"), F.length("source_root") + 1, F.lit(1 << 30)),
    ).otherwise(F.concat(F.lit("/"), file_name(F.col("image_id"))))
    relative = below if keep_subfolder else F.concat(F.lit("/"), file_name(F.col("image_id")))
    claims = moving.select(
        F.col("image_id").alias("id"), "group_id", "role", "source_root", "file_size",
        F.concat(F.lit(main), relative).alias("target"),
        F.when(F.col("role") == "original", 0).otherwise(1).alias("phase"),
    )
    taken = features.filter(inside).select(F.col("image_id").alias("path"))
    placed = assign_targets(claims, taken).select(
        F.lit("copy" if copying else "move").alias("action"), F.col("id").alias("from_path"),
        F.col("final").alias("to_path"), "group_id", "role", "renamed", "source_root", "file_size",
    )
    stays = rows.filter(F.col("role").isin("duplicate", "source_trash")).select(
        F.lit("move").alias("action"), F.col("image_id").alias("from_path"), F.col("image_id").alias("to_path"),
        "group_id", "role", F.lit(False).alias("renamed"), "source_root", "file_size",
    )
    return placed.unionByName(stays)


def merge_summary(ops: DataFrame, mode: str = "destructive") -> DataFrame:
    """One row of counters. Space grows by unique files in both modes, by group originals only when copying."""
    to_main = F.col("role").isin("original", "unique")
    grows = to_main if mode == "nondestructive" else F.col("role") == "unique"
    return ops.agg(
        F.count_if(F.col("role") == "unique").alias("n_unique"),
        F.count_distinct("group_id").alias("n_groups"),
        F.count_if(to_main).alias("n_to_main"),
        F.count_if("renamed").alias("n_suffix_renames"),
        F.coalesce(F.sum(F.when(grows, F.col("file_size"))), F.lit(0)).alias("space_delta"),
    )


def merge_trash(ops: DataFrame, mode: str, listing: DataFrame) -> DataFrame:
    """Where a merge's duplicates go: ``trash`` beside each file when moving, one per source root when copying."""
    dups = ops.filter(F.col("role").isin("duplicate", "source_trash"))
    dups = dups.join(listing.select(F.col("path").alias("from_path")), "from_path", "left_semi")
    home = F.col("source_root") if mode == "nondestructive" else parent_dir(F.col("from_path"))
    claims = dups.select(
        F.col("from_path").alias("id"), "group_id",
        F.concat(home, F.lit("/trash/"), file_name(F.col("from_path"))).alias("target"), F.lit(0).alias("phase"),
    )
    return assign_targets(claims, listing.select("path")).select(
        F.lit("merge_trash").alias("type"), F.col("id").alias("from_path"), F.col("final").alias("to_path"),
        F.lit("planned").alias("status"), "group_id",
    )
