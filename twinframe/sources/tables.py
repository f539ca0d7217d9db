"""Stored tables: caches, indexes, manifests, results and exports.

A table that is replaced as a whole, or one key of it at a time, is a folder of snapshots and a log. A replacement is
written beside what is there; one row appended to the log makes it current, and readers follow the log. What fails
before that row leaves the table as it was, and readers of an older snapshot keep it. ``drop_old_snapshots`` frees what no
key points at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe import schemas
from twinframe.functions import labels
from twinframe.functions.paths import file_name
from twinframe.operators.folders import with_ancestor
from twinframe.operators.ranking import rank_in_large_groups

RESULTS_VERSION = 1
# The columns of the export.
CSV_COLUMNS = [
    "group_id", "is_series", "role", "filename", "path", "width", "height", "pixels", "file_size_kb", "mtime",
    "brightness", "metadata_count", "companions", "camera_make", "camera_model", "lens_model", "iso", "aperture",
    "shutter_speed", "focal_length", "date_taken", "gps_lat", "gps_lon",
]


DOCUMENT_MEMBERS = 1000
LOG = "key string, version long, folder string"


def _current(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """The newest version of each key and its folder: one row per key."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    newest = log.groupBy("key").agg(F.max(F.struct("version", "folder")).alias("m"))
    return {r.key: (r.m.version, r.m.folder) for r in newest.collect()}


def _point_at(spark: SparkSession, path: str, key: str, version: int, folder: str) -> None:
    """Make a snapshot current. The row is committed by the rename of one file."""
    spark.createDataFrame([(key, version, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def replace_snapshot(df: DataFrame, path: str, key: str = "") -> None:
    """Replace the rows of one key; other keys stay. ``df`` may read the table it replaces."""
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _point_at(spark, path, key, _current(spark, path).get(key, (0, ""))[0] + 1, folder)


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None, key: str | None = None) -> DataFrame:
    """The current rows of all keys, or of one."""
    current = _current(spark, path)
    folders = [f"{path}/{folder}" for k, (_, folder) in sorted(current.items()) if key is None or k == key]
    if not folders:
        return spark.createDataFrame([], schema or "key string")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*folders)


def drop_old_snapshots(spark: SparkSession, path: str) -> int:
    """Delete the snapshots that no key points at, and say how many. No write to the table may be under way."""
    from pyarrow.fs import FileSelector, FileSystem

    kept = {folder for _, folder in _current(spark, path).values()}
    store, place = FileSystem.from_uri(path) if ":" in path else FileSystem.from_uri("file://" + path)
    old = [f.path for f in store.get_file_info(FileSelector(place)) if f.base_name.startswith("data-") and f.base_name not in kept]
    for folder in old:
        store.delete_dir(folder)
    return len(old)


# Feature and video caches -------------------------------------------------------------------------

def save_feature_cache(features: DataFrame, path: str, root: str) -> None:
    """Replace the cache of one tracked folder; other folders keep theirs."""
    root = root.rstrip("/")
    replace_snapshot(features.withColumn("cache_root", F.lit(root)), path, root)


def load_feature_cache(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    return read_snapshot(spark, path, schemas.FEATURES + ", cache_root string", folder and folder.rstrip("/"))


def save_video_cache(videos: DataFrame, path: str, root: str) -> None:
    root = root.rstrip("/")
    replace_snapshot(videos.withColumn("cache_root", F.lit(root)), path, root)


def load_video_cache(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Rows of the first version have no duration and no frames: missing columns read as null."""
    cache = read_snapshot(spark, path, schemas.VIDEO_FEATURES + ", cache_root string", folder and folder.rstrip("/"))
    return cache.withColumn("frame_hashes", F.coalesce("frame_hashes", F.array().cast("array<bigint>")))


# Tracked folders ----------------------------------------------------------------------------------

def save_tracked_folders(folders: DataFrame, path: str) -> None:
    """Replace the index. ``folders`` may come from the index itself."""
    replace_snapshot(folders, path)


def load_tracked_folders(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    table = read_snapshot(spark, path, schemas.TRACKED_FOLDERS)
    return table if folder is None else table.filter(F.col("path") == folder.rstrip("/"))


def without_folder(folders: DataFrame, gone: DataFrame) -> DataFrame:
    return folders.join(gone.select("path"), "path", "left_anti")


def set_folder(folders: DataFrame, entry: DataFrame) -> DataFrame:
    """Add or replace folders; entries below a new one are covered by it and dropped."""
    new = entry.select(F.col("path").alias("new"))
    covered = with_ancestor(folders, "path", new, "new").select("path").union(
        folders.join(new, F.col("path") == F.col("new")).select("path"))
    return without_folder(folders, covered).unionByName(entry)


# Manifests, history, results ----------------------------------------------------------------------

def append_manifest(ops: DataFrame, path: str, run_id: str) -> None:
    """Add a run to the manifest; earlier runs stay."""
    wanted = ["type", "from_path", "to_path", "status", "group_id", "role", "renamed"]
    have = {"role": F.lit(None).cast("string"), "renamed": F.lit(None).cast("boolean")}
    columns = [F.col(c) if c in ops.columns else have[c].alias(c) for c in wanted]
    ops.select(F.lit(run_id).alias("run_id"), *columns).write.mode("append").parquet(path)


def load_manifest(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    table = spark.read.schema(schemas.OPS_MANIFEST).parquet(path)
    return table if run_id is None else table.filter(F.col("run_id") == run_id)


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCAN_HISTORY).parquet(path)


def save_results(members: DataFrame, features: DataFrame, broken: DataFrame, path: str, scan_id: str) -> None:
    """Groups with the facts of each member, solo files and broken files of one scan, in one table."""
    facts = features.drop("histogram")
    grouped = members.join(facts, "image_id")
    solo = facts.join(members.select("image_id"), "image_id", "left_anti").withColumn("role", F.lit("solo"))
    bad = broken.select(F.col("path").alias("image_id"), "file_size").withColumn("role", F.lit("broken"))
    rows = grouped.unionByName(solo, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
    replace_snapshot(rows.withColumns({"version": F.lit(RESULTS_VERSION), "scan_id": F.lit(scan_id)}), path, scan_id)


def load_results(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """Rows of one scan; results of another version are not read."""
    table = read_snapshot(spark, path, key=scan_id)
    return table.filter(F.col("version") == RESULTS_VERSION) if "version" in table.columns else table.drop("key")


# Exports ------------------------------------------------------------------------------------------

def group_documents(members: DataFrame, features: DataFrame) -> DataFrame:
    """The documents of a group, as they are written to JSON: ``group_id, part, is_series, originals, previews``.

    The format is the same for every group: its members in order of ``image_id``, ``DOCUMENT_MEMBERS`` to a document,
    numbered by ``part`` from 0. No task gathers more than a document, whatever the size of the group.
    """
    facts = features.select(
        "image_id", "name", "width", "height", "file_size", F.col("mtime").cast("timestamp").cast("double").alias("t"),
        F.round("brightness", 2).alias("brightness"), "metadata_count", "companions",
    )
    rows = members.join(facts, "image_id").withColumn("doc", F.struct(
        F.col("image_id").alias("path"), F.col("name").alias("filename"), "width", "height", "file_size",
        F.col("t").alias("mtime"), "brightness", "metadata_count", "companions",
    ))
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("doc"))))
    series = members.groupBy("group_id").agg(F.max("is_series").alias("is_series"))
    rows = rank_in_large_groups(rows.select("group_id", "image_id", "role", "doc"), "group_id", "image_id")
    rows = rows.withColumn("part", F.floor(F.col("rank") / DOCUMENT_MEMBERS).cast("int")).join(series, "group_id")
    return rows.groupBy("group_id", "part").agg(
        F.max("is_series").alias("is_series"), of("original").alias("originals"), of("preview").alias("previews")
    )


def save_group_documents(members: DataFrame, features: DataFrame, path: str) -> None:
    group_documents(members, features).write.mode("overwrite").json(path)


def csv_rows(members: DataFrame, features: DataFrame, exif: DataFrame | None = None) -> DataFrame:
    """One row per group member with the export's columns. ``exif(path, exif)`` is optional.

    The two GPS columns are part of the format and always empty.
    """
    rows = members.join(features.drop("is_series", "role"), "image_id")
    if exif is not None:
        rows = rows.join(exif.withColumnRenamed("path", "image_id"), "image_id", "left")
    else:
        rows = rows.withColumn("exif", F.lit(None).cast("map<string,string>"))
    tags = F.col("exif")
    text = lambda *names: labels.exif_text(tags, *names)
    taken = F.coalesce(*[
        F.nullif(F.try_element_at(tags, F.lit(t)), F.lit("")) for t in ("DateTimeOriginal", "DateTime")
    ], F.lit(""))
    values: dict[str, Column] = {
        "filename": file_name(F.col("image_id")), "path": F.col("image_id"),
        "pixels": F.col("width").cast("long") * F.col("height"), "file_size_kb": F.round(F.col("file_size") / 1024, 1),
        "mtime": F.col("mtime").cast("timestamp").cast("double"), "brightness": F.round("brightness", 2),
        "companions": F.array_join("companions", "; "), "camera_make": text("Make"), "camera_model": text("Model"),
        "lens_model": text("LensModel", "Lens"), "iso": text("ISOSpeedRatings"),
        "aperture": labels.exif_aperture(tags), "shutter_speed": labels.exif_shutter(tags),
        "focal_length": labels.exif_focal(tags), "date_taken": taken, "gps_lat": F.lit(""), "gps_lon": F.lit(""),
    }
    return rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in CSV_COLUMNS])


def save_csv(members: DataFrame, features: DataFrame, path: str, exif: DataFrame | None = None) -> None:
    csv_rows(members, features, exif).write.mode("overwrite").option("header", "true").csv(path)
