"""File listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.config import RAW_EXTENSIONS, VIDEO_EXTENSIONS
from twinframe.functions.paths import with_path_parts


def plain_path(uri: Column) -> Column:
    """``file:/x`` and ``file:///x`` are ``/x``; other schemes keep their name."""
    return F.regexp_replace(uri, "^file:/+", "/")


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Every visible file below a root (or directly in it): path parts, ``file_size`` and ``mtime``.

    File contents are not read: the column is dropped before the scan is planned. Spark's file sources leave out
    empty files and names that start with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(root).select(
        plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"),
        F.col("length").alias("file_size"),
    )
    return with_path_parts(files, "path").withColumn("is_raw", F.col("ext").isin(RAW_EXTENSIONS))


def list_videos(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Video files; empty ones are dropped."""
    files = list_files(spark, root, recursive)
    return files.filter(F.col("ext").isin(VIDEO_EXTENSIONS) & (F.col("file_size") > 0))
