"""Counts and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.config import DEFAULT_SKIP_NAMES
from twinframe.operators.filters import of_class
from twinframe.operators.folders import with_ancestor
from twinframe.operators.groups import display_ids


def report_totals(members: DataFrame, features: DataFrame) -> DataFrame:
    """One row: scanned files, groups, burst groups, kept and removable files, bytes that could be freed."""
    sizes = members.join(features.select("image_id", "file_size"), "image_id")
    counts = sizes.agg(
        F.count_distinct("group_id").alias("groups"),
        F.count_distinct(F.when(F.col("is_series"), F.col("group_id"))).alias("series_groups"),
        F.count_if(F.col("role") == "original").alias("originals"),
        F.count_if(F.col("role") == "preview").alias("previews"),
        F.coalesce(F.sum(F.when(F.col("role") == "preview", F.col("file_size"))), F.lit(0)).alias("bytes_reclaimed"),
    )
    return features.agg(F.count(F.lit(1)).alias("scanned")).join(counts)  # one row against one row


def scan_summary(members: DataFrame, features: DataFrame) -> DataFrame:
    """One row: kept, duplicates, ambiguous groups, solo files, space saved."""
    rows = features.select("image_id", "file_size").join(
        members.select("image_id", "group_id", "role", "is_ambiguous"), "image_id", "left"
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("group_id").alias("groups"),
        F.count_if(F.col("role") == "original").alias("kept"),
        F.count_if(F.col("role") == "preview").alias("duplicates"),
        F.count_distinct(F.when(F.col("is_ambiguous"), F.col("group_id"))).alias("ambiguous"),
        F.count_if(F.col("role").isNull()).alias("solo"),
        F.coalesce(F.sum(F.when(F.col("role") == "preview", F.col("file_size"))), F.lit(0)).alias("space_saved"),
    )


def per_folder_counts(members: DataFrame, root: str = "root") -> DataFrame:
    """Per source folder: groups touched, files to copy, internal duplicates. ``members`` holds the folder."""
    return members.groupBy(root).agg(
        F.count_distinct("group_id").alias("groups"),
        F.count_if(F.col("role") == "original").alias("to_copy"),
        F.count_if(F.col("role") == "preview").alias("duplicates"),
    )


def images_per_root(listing: DataFrame, roots: DataFrame, skip_names: list[str] = DEFAULT_SKIP_NAMES) -> DataFrame:
    """``(root, images)``: image and RAW files below each root of ``roots(root)``, without skipped folders. A root
    without images counts zero; a file below two listed roots counts for both."""
    inside = with_ancestor(of_class(listing, "image", "raw"), "path", roots, "root")
    relative = F.split(F.expr("substring(dir, length(root) + 2)"), "/")
    if skip_names:
        inside = inside.filter(~F.arrays_overlap(relative, F.array(*[F.lit(n) for n in skip_names])))
    counts = inside.groupBy("root").agg(F.count(F.lit(1)).alias("images"))
    return roots.select("root").distinct().join(counts, "root", "left").na.fill(0, ["images"])


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def history_row(summary: DataFrame, src_folder: str, dry_run: bool = True, applied: bool = False,
                duration_s: float = 0.0) -> DataFrame:
    """One scan as a row of the history, from :func:`scan_summary`."""
    share = F.when(F.col("total") > 0, F.col("duplicates") / F.col("total") * 100).otherwise(F.lit(0.0))
    return summary.select(
        F.current_timestamp().alias("date"), F.lit(round(duration_s, 1)).alias("duration_s"),
        F.lit(src_folder).alias("src_folder"), F.col("total").alias("total_files"), "groups", "duplicates",
        F.round(share, 2).alias("dup_pct"), F.lit(dry_run).alias("dry_run"), F.lit(applied).alias("applied"),
    )


def page(members: DataFrame, number: int, groups_per_page: int = 20) -> DataFrame:
    """Members of the groups on one page, pages counted from 1."""
    shown = display_ids(members, "").withColumn("position", F.col("display_id").cast("long"))
    return shown.filter(F.ceil(F.col("position") / groups_per_page) == number).drop("display_id")


def paged(members: DataFrame, solos: DataFrame, groups_per_page: int = 20) -> DataFrame:
    """``(page, group_id, image_id)`` of a whole report: groups in order, then all solo files on a page of their own.

    Pages count from 1. Without groups the first page is empty and the solo files are on the second.
    """
    shown = display_ids(members, "").withColumn("page", F.ceil(F.col("display_id").cast("long") / groups_per_page))
    last = members.agg(F.greatest(F.ceil(F.count_distinct("group_id") / groups_per_page), F.lit(1)).alias("last"))
    alone = solos.join(last).select(  # one row
        (F.col("last") + 1).alias("page"), F.lit(None).cast("string").alias("group_id"), "image_id")
    return shown.select("page", "group_id", "image_id").unionByName(alone)


def folder_pages(members: DataFrame, folder: str = "root") -> DataFrame:
    """``(page, folder, group_id, image_id)``: one page for each source folder, with every group that has a member there.

    Folders are in order of their names. A group over several folders is on the page of each. ``members`` holds the
    folder in the column ``folder``.
    """
    numbers = display_ids(members.select(F.col(folder).alias("group_id")).distinct(), "").select(
        F.col("group_id").alias("folder"), F.col("display_id").cast("long").alias("page"))
    touched = members.select("group_id", F.col(folder).alias("folder")).distinct().join(numbers, "folder")
    return touched.join(members.select("group_id", "image_id"), "group_id").select("page", "folder", "group_id", "image_id")


def f1_score(found: Column, total: Column, false_positives: Column) -> Column:
    """F1 over groups, zero when nothing is right."""
    precision = F.when(found + false_positives > 0, found / (found + false_positives)).otherwise(F.lit(0.0))
    recall = F.when(total > 0, found / total).otherwise(F.lit(0.0))
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def top_rows(results: DataFrame, by: str, corpus: str | None = None, n: int = 5) -> DataFrame:
    """The best ``n`` configurations (per corpus); ties go to the first tested."""
    window = Window.partitionBy(corpus) if corpus else Window.partitionBy(F.lit(0))
    # A results table has one row per tested configuration: some hundred rows.
    ranked = results.withColumn("rank", F.row_number().over(window.orderBy(F.desc(by), "combo_id")))
    return ranked.filter(F.col("rank") <= n)
