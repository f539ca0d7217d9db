"""Filters over listings and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.config import DEFAULT_SKIP_NAMES
from twinframe.functions.labels import exif_listing
from twinframe.functions.paths import in_folder, media_class


def skip_folders(listing: DataFrame, root: str, names: list[str] = DEFAULT_SKIP_NAMES, outputs: list[str] = ()):
    """Drop files below a folder with a skipped name (inside ``root``) and files inside the output folders."""
    relative = F.substring("dir", len(root.rstrip("/")) + 1, 1 << 30)
    keep = ~F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(True)
    for out in outputs:
        keep = keep & ~in_folder(F.col("path"), F.lit(out))
    return listing.filter(keep)


def at_least(features: DataFrame, min_dimension: int) -> DataFrame:
    return features.filter(F.greatest("width", "height") >= min_dimension) if min_dimension > 0 else features


def of_class(listing: DataFrame, *classes: str) -> DataFrame:
    """Files of the classes ``image``, ``raw`` or ``video``."""
    return listing.filter(media_class(F.col("ext")).isin(*classes))


def split_broken(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(readable, broken)``: a file that could not be decoded comes back with a negative or missing width."""
    bad = F.coalesce(F.col("width"), F.lit(-1)) < 0
    return decoded.filter(~bad), decoded.filter(bad)


def not_in_trash(paths: DataFrame, column: str, trash: str) -> DataFrame:
    return paths.filter(~in_folder(F.col(column), F.lit(trash)))


def exif_attributes(files: DataFrame) -> DataFrame:
    """One row per shown EXIF tag of a file with an ``exif`` map."""
    return files.select("path", F.posexplode(exif_listing(F.col("exif"))).alias("position", "e")).select(
        "path", "position", "e.tag", "e.value"
    )
