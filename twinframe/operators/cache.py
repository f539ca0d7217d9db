"""The incremental feature cache: what is fresh, what must be read again, and how entries move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.paths import in_folder
from twinframe.operators.folders import with_ancestor


def _fresh(listing: Column, cached: Column, hash_mode: str, trust: bool) -> Column:
    """A cached row still stands for a listed file.

    RAW rows must have been read in the wanted mode, trusted or not; a row from before rotations were kept is read
    again unless it is trusted.
    """
    mode = ~listing["is_raw"] | (F.coalesce(cached["hash_mode"], F.lit("")) == hash_mode)
    if trust:
        return mode
    same = (listing["mtime"] == cached["mtime"]) & (listing["file_size"] == cached["file_size"])
    return mode & same & cached["phash_r90"].isNotNull()


def split_by_cache(
    listing: DataFrame, cache: DataFrame, hash_mode: str = "embedded", trust: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: cached feature rows that can be used, and listed files that need new features."""
    wanted = F.struct("mtime", "file_size", "is_raw")
    l = listing.select("image_id", wanted.alias("l"))
    joined = cache.withColumn("c", F.struct("mtime", "file_size", "hash_mode", "phash_r90")).join(l, "image_id")
    hits = joined.filter(_fresh(F.col("l"), F.col("c"), hash_mode, trust)).drop("l", "c")
    return hits, listing.join(hits.select("image_id"), "image_id", "left_anti")


def refresh(listing: DataFrame, cache: DataFrame, compute, hash_mode: str = "embedded", trust: bool = False):
    """The feature table of a listing: cached rows where fresh, ``compute(misses)`` for the rest."""
    hits, misses = split_by_cache(listing, cache, hash_mode, trust)
    return hits.unionByName(compute(misses), allowMissingColumns=True)


def cache_status(listing: DataFrame, cache: DataFrame, by: str = "dir", hash_mode: str = "embedded") -> DataFrame:
    """Per folder: files in total, and files that are new or changed."""
    _, misses = split_by_cache(listing, cache, hash_mode)
    stale = misses.select("image_id", F.lit(1).alias("stale"))
    return listing.join(stale, "image_id", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count("stale").alias("stale")
    )


def merged_cache(cache: DataFrame, tracked: DataFrame, folder: str) -> DataFrame:
    """Entries of one folder from its own cache and from the caches of its ancestors.

    ``cache`` holds ``cache_root``. The folder's own entry wins, then that of the nearest ancestor.
    """
    target = folder.rstrip("/")
    roots = with_ancestor(
        cache.sparkSession.range(1).select(F.lit(target + "/x").alias("p")), "p",
        tracked.select(F.col("path").alias("cache_root")), "cache_root",
    ).select("cache_root").union(cache.sparkSession.range(1).select(F.lit(target))).distinct()
    rows = cache.filter(F.col("image_id").startswith(target + "/") | (F.col("cache_root") == target))
    rows = rows.join(roots, "cache_root", "left_semi")
    depth = F.length("cache_root")
    best = rows.groupBy("image_id").agg(F.max(depth).alias("depth"))
    return rows.join(best, "image_id").filter(depth == F.col("depth")).drop("depth")


def update_video_cache(old: DataFrame, listing: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows whose file still exists, replaced by new rows of the same path."""
    kept = old.join(listing.select("path"), "path", "left_semi").join(new.select("path"), "path", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def apply_merge_to_cache(cache: DataFrame, ops: DataFrame) -> DataFrame:
    """Cache keys after a merge: a move renames the row, a copy adds a second one, everything else stays."""
    done = ops.filter("role <> 'duplicate'").select(
        F.col("from_path").alias("image_id"), F.col("to_path"), F.col("action")
    )
    joined = cache.join(done, "image_id", "left")
    targets = (
        F.when(F.col("action") == "move", F.array("to_path"))
        .when(F.col("action") == "copy", F.array("image_id", "to_path"))
        .otherwise(F.array("image_id"))
    )
    return joined.withColumn("image_id", F.explode(targets)).select(*cache.columns)


def remap_folder(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Rewrite paths below ``old`` to lie below ``new``."""
    old, new = old.rstrip("/"), new.rstrip("/")
    moved = lambda c: F.when(
        in_folder(F.col(c), F.lit(old)), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))
    ).otherwise(F.col(c))
    return df.withColumns({c: moved(c) for c in columns})
