"""Columns over file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.config import IMAGE_EXTENSIONS, RAW_EXTENSIONS, VIDEO_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def media_class(ext: Column) -> Column:
    return (
        F.when(ext.isin(IMAGE_EXTENSIONS), "image")
        .when(ext.isin(RAW_EXTENSIONS), "raw")
        .when(ext.isin(VIDEO_EXTENSIONS), "video")
    )


def in_folder(path: Column, folder: Column) -> Column:
    """The folder itself or anything below it; ``/foo`` does not contain ``/foobar``."""
    root = F.rtrim(folder, F.lit("/"))
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def folder_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def with_path_parts(df: DataFrame, path: str) -> DataFrame:
    p = F.col(path)
    return df.withColumns({"dir": parent_dir(p), "name": file_name(p), "stem": stem(p), "ext": extension(p)})


def ancestors(path: Column) -> Column:
    """Every proper ancestor folder of a path, nearest last (``/a/b/c.jpg`` gives ``/a``, ``/a/b``)."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))),
        lambda i: F.when(i <= F.size(parts) - 1, F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
