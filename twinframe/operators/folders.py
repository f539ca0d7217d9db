"""Operators over folders: coverage, ancestors, fingerprints, companions and sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.config import RAW_EXTENSIONS, SIDECAR_EXTENSIONS
from twinframe.functions.paths import ancestors, in_folder
from twinframe.operators.ranking import rank_in_large_groups

FINGERPRINT_FILES = 50
HASHES = 4


def with_ancestor(df: DataFrame, path: str, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """Pairs of a row and each listed folder above it: the row's own ancestors are looked up, so no prefix is
    compared with every folder. Rows without a listed ancestor drop out."""
    up = df.withColumn(folder, F.explode(ancestors(F.col(path))))
    return up.join(folders.select(folder).distinct(), folder)


def nearest_ancestor(df: DataFrame, path: str, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """``(path, folder)``: the longest listed proper ancestor; the empty string when there is none."""
    near = with_ancestor(df.select(path).distinct(), path, folders, folder)
    best = near.groupBy(path).agg(F.max_by(folder, F.length(folder)).alias(folder))
    return df.join(best, path, "left").withColumn(folder, F.coalesce(folder, F.lit("")))


def source_root(path: Column, roots: list[str]) -> Column:
    """The first root that contains the path, else the first root. The caller lists the roots."""
    hits = [F.when(in_folder(path, F.lit(r)), F.lit(r.rstrip("/"))) for r in roots]
    return F.coalesce(*hits, F.lit(roots[0].rstrip("/")))


def drop_covered(folders: DataFrame, folder: str = "path") -> DataFrame:
    """Folders that lie in no other listed folder."""
    covered = with_ancestor(
        folders.select(F.col(folder).alias("_p")), "_p", folders.select(F.col(folder).alias("_f")), "_f"
    )
    return folders.join(covered.select(F.col("_p").alias(folder)).distinct(), folder, "left_anti")


def folder_fingerprints(listing: DataFrame) -> DataFrame:
    """``(dir, fingerprint)`` over all names of a folder, in any order and number: SHA-256 of the count and of the sums
    of the four 64-bit quarters of each name's own SHA-256, which combine map-side."""
    names = listing.select("dir", "name").distinct().withColumn("digest", F.sha2("name", 256))
    # Sums of unsigned quarters in decimals wrap nowhere.
    quarters = [
        F.sum(F.conv(F.substring("digest", 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"q{k}")
        for k in range(HASHES)
    ]
    sums = names.groupBy("dir").agg(F.count(F.lit(1)).cast("string").alias("n"), *quarters)
    return sums.select("dir", F.sha2(F.concat_ws(":", "n", *[f"q{k}" for k in range(HASHES)]), 256).alias("fingerprint"))


def first_names_fingerprints(listing: DataFrame, max_files: int = FINGERPRINT_FILES) -> DataFrame:
    """``(dir, fingerprint)``: SHA-256 over the first names of a folder only, at most ``max_files`` of them; a change
    behind them is not seen."""
    names = listing.select("dir", "name").distinct()
    ranked = rank_in_large_groups(names, "dir", "name").filter(F.col("rank") < max_files)
    joined = F.array_join(F.array_sort(F.collect_list("name")), "\n")
    return ranked.groupBy("dir").agg(F.sha2(joined, 256).alias("fingerprint"))


def verify_fingerprints(tracked: DataFrame, listing: DataFrame) -> DataFrame:
    """Tracked folders with ``matches``: whether the files there still give the stored fingerprint."""
    empty = F.sha2(F.lit(""), 256)  # of a folder without files
    now = folder_fingerprints(listing).withColumnRenamed("dir", "path")
    return tracked.join(now, "path", "left").withColumn(
        "matches", F.col("folder_fingerprint") == F.coalesce("fingerprint", empty)
    ).drop("fingerprint")


def attach_raw_companions(images: DataFrame, listing: DataFrame) -> DataFrame:
    """``companions``: the RAW file beside an image, for catalogues that do not hash RAW files.

    One RAW and one image per folder and stem take part: the last of each.
    """
    key = [F.col("dir"), F.lower("stem").alias("stem_key")]
    raws = listing.filter(F.col("ext").isin(RAW_EXTENSIONS)).groupBy(*key).agg(F.max("path").alias("raw"))
    last = images.filter(~F.col("ext").isin(RAW_EXTENSIONS)).groupBy(*key).agg(F.max("image_id").alias("image_id"))
    pairs = last.join(raws, ["dir", "stem_key"]).select("image_id", "raw")
    return images.join(pairs, "image_id", "left").withColumn(
        "companions",
        F.when(F.col("raw").isNotNull(), F.array("raw")).otherwise(F.array().cast("array<string>")),
    ).drop("raw")


def sidecars(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``(path, sidecar)``: files with the same folder and stem and a sidecar extension, one per extension.

    The lower-case extension is taken first, then the upper-case one; mixed case is not looked for.
    """
    suffix = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    sides = listing.filter(F.col("ext").isin(SIDECAR_EXTENSIONS)).filter(
        (suffix == F.lower(suffix)) | (suffix == F.upper(suffix))
    )
    sides = sides.groupBy("dir", "stem", "ext").agg(F.max_by("path", suffix).alias("sidecar"))
    return files.join(sides.withColumnRenamed("ext", "sidecar_ext"), ["dir", "stem"]).select("path", "sidecar")
