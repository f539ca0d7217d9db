"""Sorting files into folders by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.config import IMAGE_EXTENSIONS, RAW_EXTENSIONS
from twinframe.functions.dates import date_folder, resolved_date
from twinframe.functions.paths import file_name
from twinframe.operators.folders import sidecars
from twinframe.operators.naming import assign_targets
from twinframe.session import materialise


def organise_plan(
    files: DataFrame, listing: DataFrame, source: str, out: str | None = None, operation: str = "move",
    date_format: str = "%Y-%m-%d", use_exif: bool = True, use_filename: bool = True, use_mtime: bool = True,
    unknown_folder: str = "unknown_date", conflict: str = "rename", include_raw: bool = True,
    move_sidecars: bool = True,
) -> DataFrame:
    """``(type, op, from_path, to_path, status, no_date)`` for every image of ``files``.

    ``files`` holds path parts, ``exif_date`` and ``mtime``; ``listing(path, dir, stem, name, ext)`` is everything
    that exists. Without ``out`` the source is organised in place.
    """
    if conflict not in ("rename", "skip", "overwrite"):
        raise ValueError(f"unknown conflict policy {conflict!r}")
    root = (out or source).rstrip("/")
    wanted = IMAGE_EXTENSIONS + (RAW_EXTENSIONS if include_raw else [])
    date = resolved_date(F.col("exif_date"), F.col("name"), F.col("mtime"), use_exif, use_filename, use_mtime)
    rows = files.filter(F.col("ext").isin(wanted)).withColumn("date", date).withColumns({
        "to_dir": F.concat(F.lit(root + "/"), date_folder(F.col("date"), date_format, unknown_folder)),
        "no_date": F.col("date").isNull(),
    })
    rows = rows.select("path", "dir", "stem", "no_date", "to_dir",
                       F.concat("to_dir", F.lit("/"), "name").alias("target"))
    rows = materialise(rows, "organise")
    there = listing.select("path")
    settled = rows.filter(F.col("dir") == F.col("to_dir")).select(
        F.col("path").alias("from_path"), F.col("target").alias("to_path"), "no_date",
        F.lit("skipped: already in target folder").alias("status"),
    )
    open_ = rows.filter(F.col("dir") != F.col("to_dir"))
    if conflict == "rename":
        claims = open_.select(F.col("path").alias("id"), "target", "no_date", F.lit(0).alias("phase"))
        moved = assign_targets(claims, there).select(
            F.col("id").alias("from_path"), F.col("final").alias("to_path"), "no_date",
            F.lit("planned").alias("status"),
        )
    else:
        planned = F.lit(True)
        if conflict == "skip":
            firsts = open_.groupBy("target").agg(F.min("path").alias("first"))
            taken = there.withColumnRenamed("path", "target").distinct().withColumn("taken", F.lit(True))
            open_ = open_.join(firsts, "target").join(taken, "target", "left")
            planned = F.col("taken").isNull() & (F.col("path") == F.col("first"))
        moved = open_.select(
            F.col("path").alias("from_path"), F.col("target").alias("to_path"), "no_date",
            F.when(planned, "planned").otherwise("skipped: target exists (conflict=skip)").alias("status"),
        )
    moved = materialise(moved, "moved")
    main = settled.unionByName(moved).withColumn("type", F.lit("organize"))
    if move_sidecars:
        going = moved.filter("status = 'planned'").select(F.col("from_path").alias("path"), "to_path").join(
            rows.select("path", "dir", "stem"), "path"
        )
        claims = sidecars(going, listing).join(going.select("path", "to_path"), "path").select(
            F.col("sidecar").alias("id"), F.lit(0).alias("phase"),
            F.concat(F.regexp_replace("to_path", "/[^/]*$", "/"), file_name(F.col("sidecar"))).alias("target"),
        ).dropDuplicates(["id"])
        held = there.union(moved.filter("status = 'planned'").select("to_path"))
        beside = assign_targets(claims, held).select(
            F.col("id").alias("from_path"), F.col("final").alias("to_path"), F.lit(False).alias("no_date"),
            F.lit("planned").alias("status"), F.lit("organize_sidecar").alias("type"),
        )
        main = main.unionByName(beside)
    return main.select("type", F.lit(operation).alias("op"), "from_path", "to_path", "status", "no_date")


def organise_summary(plan: DataFrame) -> DataFrame:
    """One row of counters."""
    image, planned = F.col("type") == "organize", F.col("status") == "planned"
    return plan.agg(
        F.count_if(image).alias("scanned"),
        F.count_if(image & planned & (F.col("op") == "move")).alias("moved"),
        F.count_if(image & planned & (F.col("op") == "copy")).alias("copied"),
        F.count_if(image & F.col("status").startswith("skipped")).alias("skipped"),
        F.count_if(F.col("status").startswith("error")).alias("errors"),
        F.count_if(image & F.col("no_date")).alias("no_date"),
        F.count_if(~image & planned).alias("sidecars"),
    )
