"""Manifests of files to move to trash, and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions.paths import file_name
from twinframe.operators.naming import assign_targets

MANIFEST = ["type", "from_path", "to_path", "status", "group_id"]


def _into(files: DataFrame, trash: str, kind: str, existing: DataFrame, phase: int = 0) -> DataFrame:
    """Planned moves of ``files(group_id, image_id)`` into one folder under free names."""
    claims = files.select(
        F.col("image_id").alias("id"), "group_id",
        F.concat(F.lit(trash.rstrip("/") + "/"), file_name(F.col("image_id"))).alias("target"),
        F.lit(phase).alias("phase"),
    )
    return assign_targets(claims, existing).select(
        F.lit(kind).alias("type"), F.col("id").alias("from_path"), F.col("final").alias("to_path"),
        F.lit("planned").alias("status"), "group_id",
    )


def trash_manifest(members: DataFrame, out_folder: str, listing: DataFrame) -> DataFrame:
    """Copies of all groups that are not ambiguous. Files no longer listed are reported as skipped."""
    copies = members.filter("role = 'preview' and not is_ambiguous").select("group_id", "image_id")
    there = listing.select(F.col("path").alias("image_id"))
    gone = copies.join(there, "image_id", "left_anti").select(
        F.lit("preview").alias("type"), F.col("image_id").alias("from_path"), F.lit("").alias("to_path"),
        F.lit("skipped: file not found").alias("status"), "group_id",
    )
    present = copies.join(there, "image_id", "left_semi")
    return _into(present, out_folder.rstrip("/") + "/trash", "preview", listing.select("path"), 0).unionByName(gone)


def trash_paths(chosen: DataFrame, trash: str, listing: DataFrame) -> DataFrame:
    """Explicitly chosen files (``group_id`` may be null); missing ones become errors."""
    there = listing.select(F.col("path").alias("image_id"))
    gone = chosen.join(there, "image_id", "left_anti").select(
        F.lit("trash").alias("type"), F.col("image_id").alias("from_path"), F.lit("").alias("to_path"),
        F.lit("error: file not found").alias("status"), "group_id",
    )
    return _into(chosen.join(there, "image_id", "left_semi"), trash, "trash", listing.select("path")).unionByName(gone)


def revert_manifest(manifest: DataFrame, listing: DataFrame, group_ids: list[str] | None = None) -> DataFrame:
    """The way back for moves that were done; names taken in the meantime are avoided."""
    done = manifest.filter("status = 'moved'")
    if group_ids is not None:
        done = done.filter(F.col("group_id").isin(group_ids))
    claims = done.select(
        F.col("to_path").alias("id"), "group_id", F.col("from_path").alias("target"), F.lit(0).alias("phase")
    )
    return assign_targets(claims, listing.select("path")).select(
        F.lit("revert").alias("type"), F.col("id").alias("from_path"), F.col("final").alias("to_path"),
        F.lit("planned").alias("status"), "group_id",
    )
