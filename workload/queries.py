"""The registered queries: each is a Spark job over whole tables, most with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinframe.config import SIDECAR_EXTENSIONS
from twinframe.functions import dates, labels, paths
from twinframe.functions.hashing import hex_to_long, long_to_hex
from twinframe.operators import cache, compare, filters, folders, groups, naming, review, summary, videos
from twinframe.operators.classify import classify
from twinframe.operators.similarity import similarity_components
from twinframe.operators.split import split_oversized
from twinframe.plans import calibrate, ground_truth, merge, organise, trash
from twinframe.session import materialise, work_root
from twinframe.sources import tables
from workload import oracle as o
from workload.derive import SETTINGS, kept_features, simhashes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_kept: dict[tuple, DataFrame] = {}

ONE_FORMAT = SETTINGS.with_(keep_all_formats=False)
OLDEST = SETTINGS.with_(keep_strategy="oldest", sort_by_exif_date=True)
WIDE = SETTINGS.with_(threshold=6, use_histogram=False)
DEMOSAICED = SETTINGS.with_(raw_use_embedded_thumb=False)
BORDERLINE = SETTINGS.with_(threshold=4)
SPLIT = WIDE.with_(use_dual_hash=False, max_group_size=10)
MAIN = "/lib/src0"
SOURCES = [f"/lib/src{i}" for i in range(1, 20)]
TRASH = "/out/trash"


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return add


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = materialise(build(), name.replace(" ", "_"))
    return _kept[key]


def stored(spark: SparkSession, name: str) -> str:
    """A fresh place for a stored table in the work folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def default_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "groups", lambda: groups.find_groups(kept_features(spark, sf_dir), SETTINGS))


GROUPED = o.with_(*o.grouped())
FEAT_TABLE = o.FEAT.lstrip()
FEAT = o.with_(FEAT_TABLE)


# Features and labels ------------------------------------------------------------------------------

@register("file_features", FEAT + """
SELECT image_id, dir, name, stem, ext, is_raw, width, height, file_size, phash, r90, r180, r270, dhash,
  brightness, round(entropy, 6) AS entropy FROM feat""")
def file_features(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    parts = paths.with_path_parts(f.drop("dir", "name", "stem", "ext"), "image_id")
    again = hex_to_long(long_to_hex(F.col("phash")))
    return parts.select(
        "image_id", "dir", "name", "stem", "ext", (paths.media_class(F.col("ext")) == "raw").alias("is_raw"),
        "width", "height", "file_size", again.alias("phash"), F.col("phash_r90").alias("r90"),
        F.col("phash_r180").alias("r180"), F.col("phash_r270").alias("r270"), "dhash",
        "brightness", F.round("hist_entropy", 6).alias("entropy"),
    )


@register("file_labels", FEAT + """
SELECT image_id,
  CASE WHEN file_size / 1048576.0 >= 1 THEN printf('%.2f MB', file_size / 1048576.0) ELSE (file_size // 1024) || ' KB' END AS size_label,
  printf('%dx%d  (%.1f MP)', width, height, width::BIGINT * height / 1000000.0) AS dim_label,
  strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M') AS date_label,
  CASE WHEN doc_id < 60 THEN doc_id || 's' WHEN doc_id < 3600 THEN printf('%dm %02ds', doc_id // 60, doc_id % 60)
    ELSE printf('%dh %02dm', doc_id // 3600, (doc_id // 60) % 60) END AS duration_label,
  substr(sha256(dir), 1, 16) AS folder_id FROM feat""")
def file_labels(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    return f.select(
        "image_id", labels.size_label(F.col("file_size")).alias("size_label"),
        labels.dimension_label(F.col("width"), F.col("height"), F.col("is_video")).alias("dim_label"),
        labels.date_label(F.col("mtime")).alias("date_label"),
        labels.duration_label(F.col("doc_id")).alias("duration_label"),
        paths.folder_id(F.col("dir")).alias("folder_id"),
    )


def _exif(f: DataFrame) -> DataFrame:
    """EXIF tags of a derived file."""
    d = F.col("doc_id")
    when = F.date_format("mtime", "yyyy:MM:dd HH:mm:ss")
    pairs = {
        "Make": F.concat(F.lit("Maker "), (d % 5).cast("string")),
        "Model": F.when(d % 4 != 0, F.concat(F.lit("Model "), (d % 7).cast("string"))),
        "Lens": F.when(d % 2 == 0, F.lit("Zoom")), "LensModel": F.when(d % 6 == 0, F.lit("Prime")),
        "ISOSpeedRatings": ((d % 8 + 1) * 100).cast("string"), "FNumber": ((d % 7 + 2) / 2).cast("string"),
        "ExposureTime": F.when(d % 9 == 0, F.lit("fast")).otherwise((F.lit(1.0) / (d % 50 + 1) * 2).cast("string")),
        "FocalLength": (d % 90 + 10.25).cast("string"),
        "DateTimeOriginal": F.when(d % 3 == 1, when), "DateTime": F.when(d % 3 != 0, when),
        "UserComment": F.lit("x"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs.items()])
    return f.select(
        F.col("image_id").alias("path"), "doc_id",
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("exif"),
    )


@register("exif_fields", FEAT + """
SELECT image_id AS path, printf('f/%.1f', (doc_id % 7 + 2) / 2.0) AS aperture,
  CASE WHEN doc_id % 9 = 0 THEN 'fast' WHEN 2.0 / (doc_id % 50 + 1) < 1 THEN
    '1/' || round_even(1 / (1.0::DOUBLE / (doc_id % 50 + 1) * 2), 0)::BIGINT || 's'
    ELSE printf('%.1fs', 1.0::DOUBLE / (doc_id % 50 + 1) * 2) END AS shutter,
  (doc_id % 90 + 10) || 'mm' AS focal,
  CASE WHEN doc_id % 6 = 0 THEN 'Prime' WHEN doc_id % 2 = 0 THEN 'Zoom' ELSE '' END AS lens,
  6 + (doc_id % 4 <> 0)::INT + (doc_id % 2 = 0)::INT + (doc_id % 6 = 0)::INT + (doc_id % 3 = 1)::INT
    + (doc_id % 3 <> 0)::INT AS n_fields,
  CASE WHEN doc_id % 3 <> 0 THEN mtime_s END AS taken_s FROM feat""")
def exif_fields(spark, sf_dir):
    e = _exif(kept_features(spark, sf_dir))
    tags = F.col("exif")
    return e.select(
        "path", labels.exif_aperture(tags).alias("aperture"), labels.exif_shutter(tags).alias("shutter"),
        labels.exif_focal(tags).alias("focal"), labels.exif_text(tags, "LensModel", "Lens").alias("lens"),
        labels.exif_field_count(tags).alias("n_fields"),
        F.unix_timestamp(dates.exif_date(tags).cast("timestamp")).alias("taken_s"),
    )


@register("exif_attributes", FEAT + """
, tagged AS (SELECT image_id, tag, CASE tag
    WHEN 'Make' THEN 'Maker ' || doc_id % 5 WHEN 'Model' THEN 'Model ' || doc_id % 7
    WHEN 'Lens' THEN 'Zoom' WHEN 'LensModel' THEN 'Prime' WHEN 'ISOSpeedRatings' THEN ((doc_id % 8 + 1) * 100)::VARCHAR
    WHEN 'ImageDescription' THEN repeat('word' || doc_id || ' ', 60)
    ELSE strftime(make_timestamp(mtime_s * 1000000), '%Y:%m:%d %H:%M:%S') END AS value
  FROM (SELECT *, unnest(['Make', 'ISOSpeedRatings', 'ImageDescription']
    || CASE WHEN doc_id % 4 <> 0 THEN ['Model'] ELSE [] END || CASE WHEN doc_id % 2 = 0 THEN ['Lens'] ELSE [] END
    || CASE WHEN doc_id % 6 = 0 THEN ['LensModel'] ELSE [] END
    || CASE WHEN doc_id % 3 = 1 THEN ['DateTimeOriginal'] ELSE [] END
    || CASE WHEN doc_id % 3 <> 0 THEN ['DateTime'] ELSE [] END) AS tag FROM feat))
SELECT image_id AS path, row_number() OVER (PARTITION BY image_id ORDER BY tag) - 1 AS position, tag, value FROM tagged""")
def exif_attributes(spark, sf_dir):
    files = _exif(kept_features(spark, sf_dir))
    shown = F.map_filter("exif", lambda k, v: ~k.isin("FNumber", "ExposureTime", "FocalLength"))
    long_value = F.repeat(F.concat(F.lit("word"), F.col("doc_id").cast("string"), F.lit(" ")), 60)
    files = files.withColumn("exif", F.map_concat(shown, F.create_map(F.lit("ImageDescription"), long_value)))
    return filters.exif_attributes(files).select("path", "position", "tag", "value")


EVENT_NAMES = """
names AS (SELECT event_id, ts, CASE event_id % 6
  WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' WHEN 1 THEN strftime(ts, '%Y-%m-%d') || ' trip.jpg'
  WHEN 2 THEN 'IMG_' || strftime(ts, '%Y') || '13' || strftime(ts, '%d') || '.jpg'
  WHEN 3 THEN '1980' || strftime(ts, '%m%d') || '.jpg' WHEN 4 THEN strftime(ts, '%Y_%m_%d-%H-%M-%S') || '.png'
  ELSE 'DSC' || event_id % 1000 || '.jpg' END AS name FROM events)"""


@register("filename_dates", o.with_(EVENT_NAMES) + """
SELECT event_id, name, CASE WHEN event_id % 6 IN (0, 4) THEN epoch(date_trunc('second', ts))::BIGINT
  WHEN event_id % 6 = 1 THEN epoch(date_trunc('day', ts))::BIGINT END AS date_s FROM names""")
def filename_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    shown = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), shown("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(k == 1, F.concat(shown("yyyy-MM-dd"), F.lit(" trip.jpg")))
        .when(k == 2, F.concat(F.lit("IMG_"), shown("yyyy"), F.lit("13"), shown("dd"), F.lit(".jpg")))
        .when(k == 3, F.concat(F.lit("1980"), shown("MMdd"), F.lit(".jpg")))
        .when(k == 4, F.concat(shown("yyyy_MM_dd-HH-mm-ss"), F.lit(".png")))
        .otherwise(F.concat(F.lit("DSC"), (F.col("event_id") % 1000).cast("string"), F.lit(".jpg")))
    )
    e = e.withColumn("name", name)
    found = F.unix_timestamp(dates.filename_date(F.col("name")).cast("timestamp"))
    return e.select("event_id", "name", found.alias("date_s"))


@register("listing_filters", FEAT + """
SELECT image_id, root FROM feat WHERE lang NOT IN ('de', 'fr') AND source <> 'src3' AND ext <> '.cr2'
  AND greatest(width, height) >= 2000""")
def listing_filters(spark, sf_dir):
    f = kept_features(spark, sf_dir).withColumn("path", F.col("image_id"))
    f = filters.skip_folders(f, "/lib", ["de", "fr"], ["/lib/src3"])
    return filters.at_least(filters.of_class(f, "image", "video"), 2000).select("image_id", "root")


# Groups -------------------------------------------------------------------------------------------

def _components(name: str, s):
    @register(name, o.with_(o.FEAT.lstrip(), o.components(s).lstrip()) + "SELECT id AS image_id, root AS component FROM comp")
    def run(spark, sf_dir):
        return similarity_components(kept_features(spark, sf_dir), s)


_components("near_duplicates", SETTINGS)
_components("near_duplicates_wide", WIDE)
_components("near_duplicates_demosaiced", DEMOSAICED)

ROLES_SQL = "SELECT group_id, image_id, role, is_series, series AS in_series FROM roles"


def _roles(name: str, s):
    @register(name, o.with_(*o.grouped(s)) + ROLES_SQL)
    def run(spark, sf_dir):
        found = (default_groups(spark, sf_dir) if s is SETTINGS
                 else groups.find_groups(kept_features(spark, sf_dir), s))
        return found.select("group_id", "image_id", "role", "is_series", "in_series")


_roles("group_roles", SETTINGS)
_roles("group_roles_one_format", ONE_FORMAT)
_roles("group_roles_oldest", OLDEST)
_roles("group_roles_large_images", SETTINGS.with_(min_dimension=2000))
_roles("group_roles_tolerant_sizes", SETTINGS.with_(series_tolerance_pct=2.0, threshold=6))
_roles("group_roles_without_bursts", SETTINGS.with_(disable_series_detection=True))


@register("split_groups", o.with_(FEAT_TABLE, o.components(SPLIT).lstrip(), o.split(SPLIT).lstrip())
          + "SELECT image_id, group_id FROM split")
def split_groups(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    return split_oversized(similarity_components(f, SPLIT), f, SPLIT)


@register("split_groups_rechecked", o.with_(FEAT_TABLE, o.components(SPLIT).lstrip(), o.split(SPLIT).lstrip(), """
rest AS MATERIALIZED (SELECT image_id FROM put WHERE centre = 0),
rest_pairs AS MATERIALIZED (SELECT ia AS x, ib AS y FROM pairs WHERE ia IN (SELECT image_id FROM rest) AND ib IN (SELECT image_id FROM rest))""",
    o.closure("rc", "SELECT x AS id FROM rest_pairs UNION SELECT y FROM rest_pairs", "SELECT x, y FROM rest_pairs").lstrip()) + """
SELECT image_id, group_id FROM split WHERE image_id NOT IN (SELECT image_id FROM rest)
UNION ALL SELECT image_id, root FROM rest LEFT JOIN rc ON rc.id = image_id""")
def split_groups_rechecked(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    return split_oversized(similarity_components(f, SPLIT), f, SPLIT, recheck_remainder=True)


@register("borderline_groups", o.with_(*o.grouped(BORDERLINE), f"""
free AS MATERIALIZED (SELECT * FROM featm WHERE image_id NOT IN (SELECT image_id FROM roles)),
bpairs AS MATERIALIZED (SELECT a.image_id AS x, b.image_id AS y FROM free a JOIN free b ON a.image_id < b.image_id
  WHERE abs(a.width / a.height - b.width / b.height) / greatest(a.width / a.height, b.width / b.height, 0.001) <= 0.05
  AND abs(a.brightness - b.brightness) <= 60
  AND {o.ham('a.phash', 'b.phash')} > 4 AND {o.ham('a.phash', 'b.phash')} <= 6)""",
    o.closure("bc", "SELECT x AS id FROM bpairs UNION SELECT y FROM bpairs", "SELECT x, y FROM bpairs").lstrip())
    + "SELECT 'amb:' || root AS group_id, id AS image_id FROM bc")
def borderline_groups(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    found = kept(spark, sf_dir, "groups at 4", lambda: groups.find_groups(f, BORDERLINE))
    return groups.borderline_groups(f, found, BORDERLINE).select("group_id", "image_id")


@register("group_numbers", GROUPED + """
SELECT group_id, image_id, 'g' || lpad(dense_rank() OVER (ORDER BY group_id)::VARCHAR, 4, '0') AS display_id FROM roles""")
def group_numbers(spark, sf_dir):
    return groups.display_ids(default_groups(spark, sf_dir)).select("group_id", "image_id", "display_id")


@register("second_page", GROUPED + """
SELECT group_id, image_id, n AS position FROM (
  SELECT group_id, image_id, dense_rank() OVER (ORDER BY group_id) AS n FROM roles) WHERE n BETWEEN 21 AND 40""")
def second_page(spark, sf_dir):
    return summary.page(default_groups(spark, sf_dir), 2).select("group_id", "image_id", "position")


@register("report_pages", GROUPED + """
SELECT ceil(n / 20)::BIGINT AS page, group_id, image_id FROM (SELECT *, dense_rank() OVER (ORDER BY group_id) AS n FROM roles)
UNION ALL SELECT greatest(ceil((SELECT count(DISTINCT group_id) FROM roles) / 20), 1)::BIGINT + 1, NULL, image_id FROM featm
WHERE image_id NOT IN (SELECT image_id FROM roles)""")
def report_pages(spark, sf_dir):
    found = default_groups(spark, sf_dir)
    return summary.paged(found, groups.solo_originals(kept_features(spark, sf_dir), found))


@register("folder_pages", GROUPED + """
SELECT page, folder, group_id, image_id FROM (SELECT DISTINCT root AS folder, group_id FROM roles)
JOIN (SELECT root AS folder, row_number() OVER (ORDER BY root) AS page FROM (SELECT DISTINCT root FROM roles)) USING (folder)
JOIN (SELECT group_id, image_id FROM roles) USING (group_id)""")
def folder_pages(spark, sf_dir):
    f = kept_features(spark, sf_dir).select("image_id", "root")
    return summary.folder_pages(default_groups(spark, sf_dir).join(f, "image_id"))


@register("solo_originals", GROUPED + "SELECT image_id FROM featm WHERE image_id NOT IN (SELECT image_id FROM roles)")
def solo_originals(spark, sf_dir):
    return groups.solo_originals(kept_features(spark, sf_dir), default_groups(spark, sf_dir)).select("image_id")


@register("report_totals", GROUPED + """
SELECT (SELECT count(*) FROM featm) AS scanned, count(DISTINCT group_id) AS groups,
  count(DISTINCT group_id) FILTER (is_series) AS series_groups, count(*) FILTER (role = 'original') AS originals,
  count(*) FILTER (role = 'preview') AS previews,
  (coalesce(sum(file_size) FILTER (role = 'preview'), 0))::BIGINT AS bytes_reclaimed FROM roles""")
def report_totals(spark, sf_dir):
    return summary.report_totals(default_groups(spark, sf_dir), kept_features(spark, sf_dir))


@register("scan_history_row", GROUPED + """
SELECT '/lib' AS src_folder, (SELECT count(*) FROM featm) AS total_files, count(DISTINCT group_id) AS groups,
  count(*) FILTER (role = 'preview') AS duplicates,
  round(count(*) FILTER (role = 'preview') / (SELECT count(*) FROM featm) * 100, 2) AS dup_pct FROM roles""")
def scan_history_row(spark, sf_dir):
    totals = summary.scan_summary(default_groups(spark, sf_dir), kept_features(spark, sf_dir))
    return summary.history_row(totals, "/lib").drop("date", "duration_s", "dry_run", "applied")


@register("scan_summary", GROUPED + """
SELECT (SELECT count(*) FROM featm) AS total, count(DISTINCT group_id) AS groups,
  count(*) FILTER (role = 'original') AS kept, count(*) FILTER (role = 'preview') AS duplicates, 0::BIGINT AS ambiguous,
  (SELECT count(*) FROM featm) - count(*) AS solo,
  coalesce(sum(file_size) FILTER (role = 'preview'), 0)::BIGINT AS space_saved FROM roles""")
def scan_summary(spark, sf_dir):
    return summary.scan_summary(default_groups(spark, sf_dir), kept_features(spark, sf_dir))


@register("folder_counts", GROUPED + """
SELECT root, count(DISTINCT group_id) AS groups, count(*) FILTER (role = 'original') AS to_copy,
  count(*) FILTER (role = 'preview') AS duplicates FROM roles GROUP BY root""")
def folder_counts(spark, sf_dir):
    f = kept_features(spark, sf_dir).select("image_id", "root")
    return summary.per_folder_counts(default_groups(spark, sf_dir).join(f, "image_id"))


@register("groups_in_folder", GROUPED + """
SELECT group_id, image_id, role FROM roles WHERE group_id IN (SELECT group_id FROM roles WHERE root = '/lib/src2')""")
def groups_in_folder(spark, sf_dir):
    return review.groups_in_folder(default_groups(spark, sf_dir), "/lib/src2").select("group_id", "image_id", "role")


# Compare ------------------------------------------------------------------------------------------

COMPARE = """
sides AS (SELECT group_id, bool_or(side = 'main') AS in_main, count(*) FILTER (side = 'check') AS n_check
  FROM roles GROUP BY group_id),
leads AS (SELECT group_id, ext, min(rk) AS lead FROM roles GROUP BY group_id, ext),
compared AS (
  SELECT group_id, image_id, CASE WHEN in_main THEN CASE WHEN side = 'main' THEN 'original' ELSE 'preview' END
    WHEN row_number() OVER (PARTITION BY group_id ORDER BY role = 'preview', lead, NOT series, rk) = 1 THEN 'original'
    ELSE 'preview' END AS role, CASE WHEN in_main THEN 'cross' ELSE 'check' END AS match
  FROM roles JOIN sides USING (group_id) JOIN leads USING (group_id, ext)
  WHERE n_check > 0 AND (in_main OR n_check > 1))"""


def _sides(spark, sf_dir) -> DataFrame:
    f = kept_features(spark, sf_dir)
    return compare.union_sides(f.filter("side = 'main'"), f.filter("side = 'check'"))


@register("compare_roles", o.with_(*o.grouped(), COMPARE) + "SELECT * FROM compared")
def compare_roles(spark, sf_dir):
    roles = compare.compare_roles(default_groups(spark, sf_dir), _sides(spark, sf_dir), SETTINGS)
    return roles.select("group_id", "image_id", "role", "match")


@register("compare_summary", o.with_(*o.grouped(), COMPARE) + """
SELECT count(DISTINCT group_id) FILTER (match = 'cross') AS cross_groups,
  count(*) FILTER (match = 'cross' AND role = 'preview') AS cross_dups,
  count(DISTINCT group_id) FILTER (match = 'check') AS check_groups,
  count(*) FILTER (match = 'check' AND role = 'preview') AS check_dups,
  count(*) FILTER (role = 'preview') AS total_dups FROM compared""")
def compare_summary(spark, sf_dir):
    return compare.compare_summary(compare.compare_roles(default_groups(spark, sf_dir), _sides(spark, sf_dir), SETTINGS))


# Plans --------------------------------------------------------------------------------------------

def _merge_sql(mode: str, strategy: str) -> str:
    copying = mode == "nondestructive"
    value = "mtime_s" if strategy == "oldest" else "-(width::BIGINT * height)"
    away = f"root <> '{MAIN}'"
    return f"""
picked AS (SELECT group_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, is_raw
  ORDER BY {away}, CASE WHEN {away} THEN {value} ELSE 0 END, image_id) AS n FROM roles) WHERE n = 1),
ops AS (
  SELECT CASE WHEN r.group_id IS NULL OR p.image_id IS NOT NULL THEN '{'copy' if copying else 'move'}' ELSE 'move' END AS action,
    f.image_id AS from_path, CASE WHEN r.group_id IS NULL OR p.image_id IS NOT NULL
      THEN '{MAIN}/' || f.name ELSE f.image_id END AS to_path,
    r.group_id, CASE WHEN r.group_id IS NULL THEN 'unique' WHEN p.image_id IS NOT NULL THEN 'original'
      ELSE '{'source_trash' if copying else 'duplicate'}' END AS role, false AS renamed, f.root AS source_root, f.file_size
  FROM featm f LEFT JOIN roles r USING (image_id) LEFT JOIN picked p USING (image_id) WHERE f.{away})"""


def _merge_ops(spark, sf_dir, mode="destructive", strategy="pixels") -> DataFrame:
    return kept(spark, sf_dir, f"merge {mode}", lambda: merge.merge_plan(
        default_groups(spark, sf_dir), kept_features(spark, sf_dir), MAIN, SOURCES, mode, strategy=strategy))


@register("merge_plan", o.with_(*o.grouped(), _merge_sql("destructive", "pixels")) + "SELECT * FROM ops")
def merge_plan(spark, sf_dir):
    return _merge_ops(spark, sf_dir)


@register("merge_plan_copying", o.with_(*o.grouped(), _merge_sql("nondestructive", "oldest")) + "SELECT * FROM ops")
def merge_plan_copying(spark, sf_dir):
    return _merge_ops(spark, sf_dir, "nondestructive", "oldest")


@register("merge_summary", o.with_(*o.grouped(), _merge_sql("destructive", "pixels")) + """
SELECT count(*) FILTER (role = 'unique') AS n_unique, count(DISTINCT group_id) AS n_groups,
  count(*) FILTER (role IN ('unique', 'original')) AS n_to_main, count(*) FILTER (renamed) AS n_suffix_renames,
  coalesce(sum(file_size) FILTER (role = 'unique'), 0)::BIGINT AS space_delta FROM ops""")
def merge_summary(spark, sf_dir):
    return merge.merge_summary(_merge_ops(spark, sf_dir))


@register("merge_trash", o.with_(*o.grouped(), _merge_sql("nondestructive", "oldest")) + """
SELECT from_path, source_root || '/trash/' || regexp_extract(from_path, '[^/]*$') AS to_path, group_id FROM ops
WHERE role = 'source_trash'""")
def merge_trash(spark, sf_dir):
    listing = kept_features(spark, sf_dir).select(F.col("image_id").alias("path"))
    ops = _merge_ops(spark, sf_dir, "nondestructive", "oldest")
    return merge.merge_trash(ops, "nondestructive", listing).select("from_path", "to_path", "group_id")


@register("merged_cache_keys", o.with_(*o.grouped(), _merge_sql("nondestructive", "oldest")) + """
SELECT image_id, doc_id FROM featm UNION ALL
SELECT to_path, doc_id FROM ops JOIN featm ON image_id = from_path WHERE action = 'copy'""")
def merged_cache_keys(spark, sf_dir):
    f = kept_features(spark, sf_dir).select("image_id", "doc_id")
    ops = _merge_ops(spark, sf_dir, "nondestructive", "oldest").filter("role <> 'source_trash'")
    return cache.apply_merge_to_cache(f, ops)


@register("collision_free_names", """
WITH claims AS (SELECT doc_id, '/main/img' || doc_id % 5 || '.jpg' AS target,
    row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id % 2, doc_id) AS n FROM documents),
taken AS (SELECT DISTINCT doc_id % 5 AS t, (doc_id % 100 // 5)::BIGINT AS k FROM documents WHERE doc_id % 3 = 0),
free AS (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY k) AS n
  FROM (SELECT t, unnest(range(0, (SELECT count(*) FROM documents))) AS k FROM range(0, 5) x(t)) ANTI JOIN taken USING (t, k))
SELECT doc_id AS id, CASE WHEN k = 0 THEN target ELSE '/main/img' || t || '_' || k || '.jpg' END AS final, k > 0 AS renamed
FROM claims JOIN free ON t = doc_id % 5 AND free.n = claims.n""")
def collision_free_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    base = F.concat(F.lit("/main/img"), (F.col("doc_id") % 5).cast("string"), F.lit(".jpg"))
    k = F.floor(F.col("doc_id") % 100 / 5)
    existing = d.filter("doc_id % 3 = 0").select(naming.numbered(base, k).alias("path")).distinct()
    claims = d.select(F.col("doc_id").alias("id"), base.alias("target"), (F.col("doc_id") % 2).alias("phase"))
    return naming.assign_targets(claims, existing).select("id", "final", "renamed")


def _listing(spark, sf_dir) -> DataFrame:
    """Everything on the derived disk: the files and their sidecars."""
    f = kept_features(spark, sf_dir)
    main = f.select(F.col("image_id").alias("path"), "dir", "stem", "name", "ext")
    side = lambda every, suffix: f.filter(F.col("doc_id") % every == 0).select(
        F.concat("dir", F.lit("/"), "stem", F.lit(suffix)).alias("path"), "dir", "stem",
        F.concat("stem", F.lit(suffix)).alias("name"), F.lit(suffix.lower()).alias("ext"),
    )
    return main.union(side(4, ".xmp")).union(side(8, ".XMP")).union(side(6, ".AAE"))


ORGANISE = """
dated AS (SELECT *, '/sorted/' || strftime(make_timestamp(coalesce(exif_s, mtime_s) * 1000000), '%Y-%m-%d') AS to_dir FROM feat),
plan AS (
  SELECT 'organize' AS type, 'move' AS op, image_id AS from_path, to_dir || '/' || name AS to_path, 'planned' AS status, false AS no_date FROM dated
  UNION ALL SELECT 'organize_sidecar', 'move', dir || '/' || stem || x, to_dir || '/' || stem || x, 'planned', false
  FROM dated, (VALUES (4, '.xmp'), (6, '.AAE')) v(e, x) WHERE doc_id % e = 0)"""


def _organise(spark, sf_dir) -> DataFrame:
    files = kept_features(spark, sf_dir).withColumn("path", F.col("image_id"))
    return organise.organise_plan(files, _listing(spark, sf_dir), "/lib", "/sorted", use_filename=False)


@register("organise_plan", o.with_(o.FEAT.lstrip(), ORGANISE) + "SELECT * FROM plan")
def organise_plan(spark, sf_dir):
    return _organise(spark, sf_dir)


@register("organise_summary", o.with_(o.FEAT.lstrip(), ORGANISE) + """
SELECT count(*) FILTER (type = 'organize') AS scanned, count(*) FILTER (type = 'organize') AS moved, 0::BIGINT AS copied,
  0::BIGINT AS skipped, 0::BIGINT AS errors, 0::BIGINT AS no_date, count(*) FILTER (type <> 'organize') AS sidecars FROM plan""")
def organise_summary(spark, sf_dir):
    return organise.organise_summary(_organise(spark, sf_dir))


# Cameras number their files alike, so names collide once folders are merged or sorted by date.

CAMERA = "SELECT *, 'DSC' || lpad((doc_id % 500)::VARCHAR, 4, '0') AS cam, doc_id // 500 AS card FROM "


def _cameras(spark, sf_dir) -> DataFrame:
    """The features with the parts of camera names: 500 numbers, and a card for each turn of the counter."""
    return kept_features(spark, sf_dir).withColumns({
        "cam": F.concat(F.lit("DSC"), F.lpad((F.col("doc_id") % 500).cast("string"), 4, "0")), "card": F.floor(F.col("doc_id") / 500)})


def _placed_at(df: DataFrame, dir_: Column, stem: Column) -> DataFrame:
    return df.withColumns({"dir": dir_, "stem": stem}).withColumns({
        "name": F.concat("stem", "ext"), "image_id": F.concat("dir", F.lit("/"), "stem", "ext")})


def _mergeable(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Members and features under camera names; what lies in main keeps names of its own there."""
    f = _cameras(spark, sf_dir)
    own = F.when(F.col("card") > 0, F.concat("cam", F.lit("_"), F.col("card").cast("string"))).otherwise(F.col("cam"))
    inside = F.col("root") == MAIN
    named = _placed_at(f, F.when(inside, F.lit(MAIN)).otherwise(F.concat("root", F.lit("/c"), F.col("card").cast("string"))),
                       F.when(inside, own).otherwise(F.col("cam")))
    ids = f.select("doc_id", "image_id").join(default_groups(spark, sf_dir).select("image_id", "group_id"), "image_id").drop("image_id")
    return ids.join(named.select("doc_id", "image_id"), "doc_id").select("group_id", "image_id"), named


def _numbers_sql(name: str, claims: str, taken: str) -> str:
    """``name``: the claims with the number ``k`` each gets; ``taken`` yields the (target, k) that exist."""
    return f"""
{name}_taken AS MATERIALIZED (SELECT DISTINCT target, k FROM ({taken})),
{name}_room AS (SELECT target, n + coalesce(t, 0) AS room FROM (SELECT target, count(*) AS n FROM {claims} GROUP BY target)
  LEFT JOIN (SELECT target, count(*) AS t FROM {name}_taken GROUP BY target) USING (target)),
{name}_free AS (SELECT target, k, row_number() OVER (PARTITION BY target ORDER BY k) AS n
  FROM (SELECT target, unnest(range(0, room)) AS k FROM {name}_room) ANTI JOIN {name}_taken USING (target, k)),
{name} AS (SELECT c.*, k FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY phase, id) AS n FROM {claims}) c
  JOIN {name}_free USING (target, n))"""


_NUMBERED = "CASE WHEN k = 0 THEN target ELSE regexp_replace(target, '(\\.[^.]+)$', '_' || k || '\\1') END"


def _renaming_merge_sql(mode: str) -> str:
    copying = mode == "nondestructive"
    away = f"root <> '{MAIN}'"
    return f"""
cams AS MATERIALIZED (SELECT * EXCLUDE (dir, name, stem), image_id AS old_id, cam || ext AS name,
    CASE WHEN {away} THEN root || '/c' || card || '/' || cam || ext
      ELSE '{MAIN}/' || cam || CASE WHEN card > 0 THEN '_' || card ELSE '' END || ext END AS path FROM ({CAMERA} featm)),
picked AS (SELECT path FROM (SELECT c.path, row_number() OVER (PARTITION BY r.group_id, c.is_raw
  ORDER BY c.{away}, CASE WHEN c.{away} THEN -(c.width::BIGINT * c.height) ELSE 0 END, c.path) AS n
  FROM cams c JOIN roles r ON r.image_id = c.old_id) WHERE n = 1),
parts AS MATERIALIZED (
  SELECT c.path AS id, r.group_id, c.root AS source_root, c.file_size, '{MAIN}/' || c.name AS target,
    CASE WHEN r.group_id IS NULL THEN 'unique' WHEN p.path IS NOT NULL THEN 'original' ELSE '{'source_trash' if copying else 'duplicate'}' END AS role,
    CASE WHEN p.path IS NULL THEN 1 ELSE 0 END AS phase
  FROM cams c LEFT JOIN roles r ON r.image_id = c.old_id LEFT JOIN picked p ON p.path = c.path WHERE c.{away}),
claims AS MATERIALIZED (SELECT * FROM parts WHERE role IN ('unique', 'original')),
{_numbers_sql('numbers', 'claims', f"SELECT '{MAIN}/' || name AS target, card AS k FROM cams WHERE root = '{MAIN}'").lstrip()},
ops AS (
  SELECT '{'copy' if copying else 'move'}' AS action, id AS from_path, {_NUMBERED} AS to_path, group_id, role, k > 0 AS renamed, source_root, file_size FROM numbers
  UNION ALL SELECT 'move', id, id, group_id, role, false, source_root, file_size FROM parts WHERE role NOT IN ('unique', 'original'))"""


def _renaming_ops(spark, sf_dir, mode="destructive") -> DataFrame:
    return kept(spark, sf_dir, f"renaming merge {mode}", lambda: merge.merge_plan(*_mergeable(spark, sf_dir), MAIN, SOURCES, mode))


@register("merge_plan_renaming", o.with_(*o.grouped(), _renaming_merge_sql("destructive")) + "SELECT * FROM ops")
def merge_plan_renaming(spark, sf_dir):
    return _renaming_ops(spark, sf_dir)


@register("merge_summary_copying", o.with_(*o.grouped(), _renaming_merge_sql("nondestructive")) + """
SELECT count(*) FILTER (role = 'unique') AS n_unique, count(DISTINCT group_id) AS n_groups,
  count(*) FILTER (role IN ('unique', 'original')) AS n_to_main, count(*) FILTER (renamed) AS n_suffix_renames,
  coalesce(sum(file_size) FILTER (role IN ('unique', 'original')), 0)::BIGINT AS space_delta FROM ops""")
def merge_summary_copying(spark, sf_dir):
    return merge.merge_summary(_renaming_ops(spark, sf_dir, "nondestructive"), "nondestructive")


@register("merge_trash_renaming", o.with_(*o.grouped(), _renaming_merge_sql("nondestructive"), f"""
dups AS MATERIALIZED (SELECT id, group_id, 0 AS phase, source_root || '/trash/' || regexp_extract(id, '[^/]*$') AS target
  FROM parts WHERE role = 'source_trash'),
{_numbers_sql('binned', 'dups', "SELECT root || '/trash/' || name AS target, 0 AS k FROM cams WHERE doc_id % 7 = 0").lstrip()}""")
    + f"SELECT id AS from_path, {_NUMBERED} AS to_path, group_id FROM binned")
def merge_trash_renaming(spark, sf_dir):
    """Every root has a trash folder that already holds some of the names."""
    ops = _renaming_ops(spark, sf_dir, "nondestructive")
    listing = _mergeable(spark, sf_dir)[1].select(F.col("image_id").alias("path"))
    binned = _cameras(spark, sf_dir).filter("doc_id % 7 = 0").select(F.concat("root", F.lit("/trash/"), "cam", "ext")).distinct()
    return merge.merge_trash(ops, "nondestructive", listing.union(binned)).select("from_path", "to_path", "group_id")


@register("moved_cache_keys", o.with_(*o.grouped(), _renaming_merge_sql("destructive")) + """
SELECT coalesce(to_path, path) AS image_id, doc_id FROM cams LEFT JOIN ops ON from_path = path""")
def moved_cache_keys(spark, sf_dir):
    """Cache keys after a merge that moves: renamed where the file went, kept where it stayed."""
    f = _mergeable(spark, sf_dir)[1].select("image_id", "doc_id")
    return cache.apply_merge_to_cache(f, _renaming_ops(spark, sf_dir))


SORTED = "/sorted/2024-01"


def _sorted_sql(conflict: str, op: str) -> str:
    """Months by the EXIF date alone; every 13th file lies in a month's folder already, which holds other files, too."""
    taken = f"SELECT '{SORTED}/' || cam || ext AS target, card AS k FROM ({CAMERA} feat) WHERE doc_id % 50 = 0"
    rename, first = _numbers_sql("moved", "claims", taken).lstrip(), ""
    if conflict == "overwrite":
        rename = "moved AS (SELECT *, 0 AS k FROM claims)"
    if conflict == "skip":
        rename = f"""there AS (SELECT target FROM ({taken}) WHERE k = 0),
moved AS (SELECT *, 0 AS k, target IN (SELECT target FROM there) OR row_number() OVER (PARTITION BY target ORDER BY id) > 1 AS skips FROM claims)"""
        first = "CASE WHEN skips THEN 'skipped: target exists (conflict=skip)' ELSE 'planned' END"
    return f"""
dated AS MATERIALIZED (SELECT *, dir || '/' || stem || ext AS path FROM (
  SELECT doc_id, ext, exif_s, CASE WHEN doc_id % 13 = 0 THEN '{SORTED}' ELSE root || '/c' || card END AS dir,
    CASE WHEN doc_id % 13 = 0 THEN 'HOME' || doc_id ELSE cam END AS stem,
    '/sorted/' || CASE WHEN exif_s IS NULL THEN 'no_date' ELSE strftime(make_timestamp(exif_s * 1000000), '%Y-%m') END AS to_dir
  FROM ({CAMERA} feat))),
claims AS MATERIALIZED (SELECT path AS id, 0 AS phase, to_dir || '/' || stem || ext AS target, exif_s IS NULL AS no_date, doc_id, dir, stem, to_dir
  FROM dated WHERE dir <> to_dir),
{rename},
done AS MATERIALIZED (SELECT *, {first or "'planned'"} AS status FROM moved),
beside AS MATERIALIZED (SELECT dir || '/' || stem || x AS id, 0 AS phase, to_dir || '/' || stem || x AS target
  FROM done, (VALUES (4, '.xmp'), (6, '.AAE')) v(e, x) WHERE doc_id % e = 0 AND status = 'planned'),
{_numbers_sql('sides', 'beside', "SELECT '' AS target, 0 AS k WHERE false").lstrip()},
plan AS (
  SELECT 'organize' AS type, '{op}' AS op, path AS from_path, path AS to_path, 'skipped: already in target folder' AS status, exif_s IS NULL AS no_date
    FROM dated WHERE dir = to_dir
  UNION ALL SELECT 'organize', '{op}', id, {_NUMBERED}, status, no_date FROM done
  UNION ALL SELECT 'organize_sidecar', '{op}', id, {_NUMBERED}, 'planned', false FROM sides)"""


def _sorted_plan(spark, sf_dir, conflict: str, op: str) -> DataFrame:
    f = _cameras(spark, sf_dir)
    home = F.col("doc_id") % 13 == 0
    files = _placed_at(f, F.when(home, F.lit(SORTED)).otherwise(F.concat("root", F.lit("/c"), F.col("card").cast("string"))),
                       F.when(home, F.concat(F.lit("HOME"), F.col("doc_id").cast("string"))).otherwise(F.col("cam")))
    files = files.withColumn("path", F.col("image_id"))
    row = lambda df, stem, ext: df.select(F.concat("dir", F.lit("/"), stem, ext).alias("path"), "dir", stem.alias("stem"),
                                          F.concat(stem, ext).alias("name"), F.lower(ext).alias("ext"))
    numbered = F.when(F.col("card") > 0, F.concat("cam", F.lit("_"), F.col("card").cast("string"))).otherwise(F.col("cam"))
    listing = row(files, F.col("stem"), F.col("ext")).union(
        row(f.filter("doc_id % 50 = 0").withColumn("dir", F.lit(SORTED)), numbered, F.col("ext")))
    for every, suffix in ((4, ".xmp"), (6, ".AAE")):
        listing = listing.union(row(files.filter(F.col("doc_id") % every == 0), F.col("stem"), F.lit(suffix)))
    return kept(spark, sf_dir, f"sorted {conflict}", lambda: organise.organise_plan(
        files, listing, "/lib", "/sorted", op, "%Y-%m", use_filename=False, use_mtime=False, unknown_folder="no_date", conflict=conflict))


POLICIES = {"rename": "copy", "skip": "move", "overwrite": "move"}


def _sorting(conflict: str, op: str):
    @register(f"organise_plan_{conflict}", o.with_(FEAT_TABLE, _sorted_sql(conflict, op)) + "SELECT * FROM plan")
    def run(spark, sf_dir):
        return _sorted_plan(spark, sf_dir, conflict, op)


for _conflict, _op in POLICIES.items():
    _sorting(_conflict, _op)


@register("organise_policies", " UNION ALL ".join(f"""SELECT '{conflict}' AS conflict, count(*) FILTER (image) AS scanned,
  count(*) FILTER (image AND planned AND op = 'move') AS moved, count(*) FILTER (image AND planned AND op = 'copy') AS copied,
  count(*) FILTER (image AND NOT planned) AS skipped, 0::BIGINT AS errors, count(*) FILTER (image AND no_date) AS no_date,
  count(*) FILTER (NOT image) AS sidecars FROM (
  {o.with_(FEAT_TABLE, _sorted_sql(conflict, op))}SELECT *, type = 'organize' AS image, status = 'planned' AS planned FROM plan)"""
    for conflict, op in POLICIES.items()))
def organise_policies(spark, sf_dir):
    """The counters of one library sorted under each policy."""
    rows = [organise.organise_summary(_sorted_plan(spark, sf_dir, conflict, op)).withColumn("conflict", F.lit(conflict))
            for conflict, op in POLICIES.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("trash_manifest", GROUPED + """
SELECT 'preview' AS type, image_id AS from_path, '/out/trash/' || name AS to_path, 'planned' AS status, group_id
FROM roles WHERE role = 'preview' AND doc_id % 9 <> 0 UNION ALL
SELECT 'preview', image_id, '', 'skipped: file not found', group_id FROM roles WHERE role = 'preview' AND doc_id % 9 = 0""")
def trash_manifest(spark, sf_dir):
    listing = kept_features(spark, sf_dir).filter("doc_id % 9 <> 0").select(F.col("image_id").alias("path"))
    return kept(spark, sf_dir, "manifest", lambda: trash.trash_manifest(default_groups(spark, sf_dir), "/out", listing))


@register("manifest_status", GROUPED + """
SELECT 'preview' AS type, CASE WHEN doc_id % 9 = 0 THEN 'skipped: file not found' ELSE 'planned' END AS status,
  count(*) AS n FROM roles WHERE role = 'preview' GROUP BY ALL""")
def manifest_status(spark, sf_dir):
    return summary.status_counts(trash_manifest(spark, sf_dir))


@register("revert_manifest", GROUPED + """
SELECT '/out/trash/' || name AS from_path, CASE WHEN doc_id % 5 = 0 THEN dir || '/' || stem || '_1' || ext ELSE image_id END
  AS to_path, group_id FROM roles WHERE role = 'preview' AND doc_id % 9 <> 0""")
def revert_manifest(spark, sf_dir):
    done = trash_manifest(spark, sf_dir).withColumn(
        "status", F.when(F.col("status") == "planned", "moved").otherwise(F.col("status"))
    )
    there = kept_features(spark, sf_dir).filter("doc_id % 5 = 0").select(F.col("image_id").alias("path"))
    return trash.revert_manifest(done, there).select("from_path", "to_path", "group_id")


# Review -------------------------------------------------------------------------------------------

DECIDED = """
rv AS (SELECT *, NOT (length(group_id) % 7 = 0) AS group_selected, doc_id % 4 <> 0 AS selected FROM roles)"""


def _decisions(spark, sf_dir) -> DataFrame:
    """Some groups and images are deselected; whatever is not mentioned counts as selected."""
    g = default_groups(spark, sf_dir)
    whole = g.filter("length(group_id) % 7 = 0").select("group_id").distinct().select(
        "group_id", F.lit(None).cast("string").alias("image_id"), F.lit(False).alias("selected")
    )
    doc = F.regexp_extract("image_id", r"doc_(\d+)", 1).cast("long")
    single = g.select("group_id", "image_id", (doc % 4 != 0).alias("selected"))
    return whole.union(single)


@register("reviewed_trash", o.with_(*o.grouped(), DECIDED) + """
SELECT image_id AS from_path, '/out/trash/' || name AS to_path, group_id FROM rv
WHERE role = 'preview' AND group_selected AND selected AND root <> '/lib/src4'""")
def reviewed_trash(spark, sf_dir):
    chosen = review.chosen_for_trash(default_groups(spark, sf_dir), _decisions(spark, sf_dir))
    chosen = filters.not_in_trash(chosen, "image_id", "/lib/src4")
    listing = kept_features(spark, sf_dir).select(F.col("image_id").alias("path"))
    return trash.trash_paths(chosen, TRASH, listing).select("from_path", "to_path", "group_id")


@register("groups_with_deselected", o.with_(*o.grouped(), DECIDED) + """
SELECT DISTINCT group_id FROM rv WHERE role = 'preview' AND NOT selected""")
def groups_with_deselected(spark, sf_dir):
    return review.groups_with_deselected(default_groups(spark, sf_dir), _decisions(spark, sf_dir))


@register("false_positive_distances", o.with_(*o.grouped(), DECIDED) + f"""
SELECT a.group_id, least({', '.join(o.distances('a', 'b'))}) AS distance, count(*)::BIGINT AS pairs
FROM rv a JOIN rv b ON a.group_id = b.group_id AND a.role = 'preview' AND NOT a.selected AND b.role = 'original' GROUP BY ALL""")
def false_positive_distances(spark, sf_dir):
    return review.false_positive_distances(
        default_groups(spark, sf_dir), _decisions(spark, sf_dir), kept_features(spark, sf_dir))


@register("suggested_threshold", o.with_(*o.grouped(), DECIDED) + f"""
SELECT min(d) AS min_distance, CASE WHEN greatest(1, min(d) - 1) < 2 THEN greatest(1, min(d) - 1) END AS suggested
FROM (SELECT least({', '.join(o.distances('a', 'b'))}) AS d
FROM rv a JOIN rv b ON a.group_id = b.group_id AND a.role = 'preview' AND NOT a.selected AND b.role = 'original')""")
def suggested_threshold(spark, sf_dir):
    return review.suggested_threshold(false_positive_distances(spark, sf_dir), SETTINGS.threshold)


@register("applied_state", o.with_(*o.grouped(), DECIDED) + """
SELECT group_id, moved, chosen, CASE WHEN moved > 0 AND moved >= chosen AND chosen > 0 THEN 'full'
  WHEN moved > 0 THEN 'partial' ELSE 'none' END AS state FROM (
  SELECT group_id, count(*) FILTER (role = 'preview' AND doc_id % 9 <> 0) AS moved,
    count(*) FILTER (role = 'preview' AND selected) AS chosen FROM rv GROUP BY group_id)""")
def applied_state(spark, sf_dir):
    done = trash_manifest(spark, sf_dir).withColumn(
        "status", F.when(F.col("status") == "planned", "moved").otherwise(F.col("status"))
    )
    return review.applied_state(default_groups(spark, sf_dir), _decisions(spark, sf_dir), done)


MANUAL = """
man AS (SELECT 'm' || doc_id % 50 AS group_id, image_id FROM featm WHERE doc_id % 20 = 7)"""


def _manual(spark, sf_dir) -> DataFrame:
    return kept_features(spark, sf_dir).filter("doc_id % 20 = 7").select(
        F.concat(F.lit("m"), (F.col("doc_id") % 50).cast("string")).alias("group_id"), "image_id"
    )


@register("review_ground_truth", o.with_(*o.grouped(), DECIDED, MANUAL, """
c AS (SELECT *, count(*) FILTER (selected) OVER (PARTITION BY group_id) AS confirmed FROM rv)""") + """
SELECT kind, CASE WHEN kind <> 'singles' THEN group_id END AS label, image_id AS path FROM (SELECT *,
  CASE WHEN NOT group_selected THEN 'negatives' WHEN selected AND confirmed >= 2 THEN 'groups' ELSE 'singles' END AS kind FROM c)
UNION SELECT 'groups', 'manual_' || group_id, image_id FROM man WHERE group_id IN
  (SELECT group_id FROM man GROUP BY group_id HAVING count(*) >= 2)
UNION SELECT 'singles', NULL, image_id FROM featm WHERE doc_id % 17 = 3 AND image_id NOT IN (SELECT image_id FROM roles)""")
def review_ground_truth(spark, sf_dir):
    g, f = default_groups(spark, sf_dir), kept_features(spark, sf_dir)
    solos = groups.solo_originals(f, g).filter("doc_id % 17 = 3").select("image_id")
    return review.decisions_to_ground_truth(g, _decisions(spark, sf_dir), _manual(spark, sf_dir), solos)


@register("manual_groups_after_removal", FEAT + """
, man AS (SELECT 'm' || doc_id % 50 AS group_id, image_id, doc_id FROM feat WHERE doc_id % 20 = 7),
kept AS (SELECT group_id, image_id FROM man WHERE doc_id % 3 <> 0),
big AS (SELECT group_id FROM kept GROUP BY group_id HAVING count(*) >= 2)
SELECT group_id, image_id FROM kept WHERE group_id IN (SELECT group_id FROM big)""")
def manual_groups_after_removal(spark, sf_dir):
    manual = _manual(spark, sf_dir)
    gone = kept_features(spark, sf_dir).filter("doc_id % 3 = 0").select("image_id").join(manual, "image_id")
    return review.remove_manual_members(manual, gone.select("group_id", "image_id"))[0]


@register("manual_groups_removed", FEAT + """
, man AS (SELECT 'm' || doc_id % 50 AS group_id, image_id FROM feat WHERE doc_id % 20 = 7)
SELECT CASE WHEN group_id IN ('m7', 'm27') THEN '' ELSE group_id END AS group_id, image_id FROM man""")
def manual_groups_removed(spark, sf_dir):
    """Two whole groups are removed; their images are listed under the empty group."""
    manual = _manual(spark, sf_dir)
    gone = manual.filter("group_id in ('m7', 'm27')").select("group_id").distinct()
    kept_, freed = review.remove_manual_groups(manual, gone)
    return kept_.unionByName(freed.select(F.lit("").alias("group_id"), "image_id"))


@register("manual_groups_created", FEAT + """
, man AS (SELECT 'm' || doc_id % 50 AS group_id, image_id FROM feat WHERE doc_id % 20 = 7)
SELECT * FROM man UNION ALL SELECT 'new', image_id FROM feat WHERE doc_id % 40 = 9""")
def manual_groups_created(spark, sf_dir):
    """One group is added; a choice of a single image adds none."""
    f = kept_features(spark, sf_dir)
    manual = review.create_manual_group(_manual(spark, sf_dir), f.filter("doc_id % 40 = 9").select("image_id"), "new")
    return review.create_manual_group(manual, f.filter("doc_id = 3").select("image_id"), "alone")


@register("images_per_root", FEAT + """
SELECT root, count(*) FILTER (lang NOT IN ('de', 'fr')) AS images FROM feat GROUP BY root UNION ALL SELECT '/nowhere', 0""")
def images_per_root(spark, sf_dir):
    f = kept_features(spark, sf_dir).withColumn("path", F.col("image_id"))
    roots = f.select("root").distinct().union(spark.range(1).select(F.lit("/nowhere")))
    return summary.images_per_root(f.drop("root"), roots, ["de", "fr"])


# Videos -------------------------------------------------------------------------------------------

def _frame_sums() -> str:
    word = "('0x' || substr(md5(w), 1, 16))::UBIGINT"
    return ", ".join(f"sum(({word} >> {k}) & 1) AS p{k}" for k in range(64))


VIDEO = f"""
slices AS (SELECT doc_id, i, substr(text, (i * (length(text) // 5) + 1)::BIGINT,
    CASE WHEN i = 4 THEN length(text) ELSE length(text) // 5 END) AS part
  FROM documents, range(0, 5) x(i)),
sw AS (SELECT doc_id, i, unnest(string_split(part, ' ')) AS w FROM slices),
ss AS (SELECT doc_id, i, count(*) AS n, {_frame_sums()} FROM sw GROUP BY doc_id, i),
fr AS (SELECT doc_id, i, {o.signed('pv')} AS h FROM (SELECT doc_id, i, {o._hash_value('p')} AS pv FROM ss)),
vid AS MATERIALIZED (
  SELECT feat.doc_id, '/vid/' || source || '/clip_' || feat.doc_id || CASE WHEN feat.doc_id % 2 = 0 THEN '.mp4' ELSE '.mov' END AS path,
    CASE WHEN feat.doc_id % 2 = 0 THEN '.mp4' ELSE '.mov' END AS ext, n_chars AS size, 1704067200 + feat.doc_id * 60 AS mtime_s,
    CASE WHEN feat.doc_id % 13 = 0 THEN 0 ELSE p0 END AS thumb, n_chars / 50.0 AS duration,
    list(fr.h ORDER BY i) AS frames
  FROM feat JOIN fr ON fr.doc_id = feat.doc_id GROUP BY ALL)"""


def _videos(spark, sf_dir) -> DataFrame:
    def build() -> DataFrame:
        d = table(spark, sf_dir, "documents")
        fifth = F.floor(F.length("text") / 5).cast("int")
        parts = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "text")
        parts = parts.select("doc_id", "i", F.expr(
            "substring(text, i * cast(floor(length(text) / 5) as int) + 1,"
            " if(i = 4, length(text), cast(floor(length(text) / 5) as int)))").alias("part"))
        frames = simhashes(parts, ["doc_id", "i"], "part", {"h": 1}).groupBy("doc_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("frame_hashes"))
        thumbs = simhashes(d, ["doc_id"], "text", {"thumb": 1})
        ext = F.when(F.col("doc_id") % 2 == 0, ".mp4").otherwise(".mov")
        return d.select("doc_id", "source", "n_chars").join(thumbs, "doc_id").join(frames, "doc_id").select(
            F.concat(F.lit("/vid/"), "source", F.lit("/clip_"), F.col("doc_id").cast("string"), ext).alias("path"),
            F.col("n_chars").alias("size"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("mtime"),
            F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("thumb")).alias("phash"),
            (F.col("n_chars") / 50.0).cast("double").alias("duration"), "frame_hashes",
        )
    return kept(spark, sf_dir, "videos", build)


def _video_parts(s) -> list[str]:
    """Both passes, from ``vid`` to ``vg(group_id, image_id, role, is_ambiguous)``."""
    near = o.ham("a.thumb", "b.thumb")
    hits = " + ".join(f"(bit_count(xor(a.frames[{i}], b.frames[{i}])) <= {s.video_frame_radius})::INT" for i in range(1, 6))
    by_size = s.video_match_format or s.video_match_size
    bucket = " || '|' || ".join((["ext"] if s.video_match_format else []) + (["size"] if s.video_match_size else [])) or "''"
    parts = [f"""
vb AS MATERIALIZED (SELECT *, {bucket} AS bkey FROM vid),
va AS MATERIALIZED (SELECT a.path AS x, b.path AS y FROM vb a JOIN vb b ON a.bkey = b.bkey AND a.path < b.path
  WHERE {'true' if by_size else 'false'} AND (a.thumb = 0 OR b.thumb = 0 OR {near} <= {s.video_thumb_radius}))""",
        o.closure("vac", "SELECT x AS id FROM va UNION SELECT y FROM va", "SELECT x, y FROM va").lstrip(), f"""
rest AS MATERIALIZED (SELECT * FROM vid WHERE path NOT IN (SELECT id FROM vac)),
vbp AS MATERIALIZED (SELECT a.path AS x, b.path AS y FROM rest a JOIN rest b ON a.path < b.path
  AND {'a.ext = b.ext' if s.video_match_format else 'true'}
  WHERE a.duration > 0 AND b.duration > 0 AND abs(a.duration - b.duration) / greatest(a.duration, b.duration) * 100 <= {s.video_duration_pct}
  AND ({hits}) / 5.0 >= {s.video_frame_ratio})""",
        o.closure("vbc", "SELECT x AS id FROM vbp UNION SELECT y FROM vbp", "SELECT x, y FROM vbp").lstrip(), """
vg0 AS (SELECT id AS path, root, (SELECT 1) AS pass FROM vac UNION ALL SELECT id, root, 2 FROM vbc),
vg AS (SELECT 'v:' || root AS group_id, path AS image_id,
  CASE WHEN row_number() OVER (PARTITION BY root ORDER BY mtime_s, -size, path) = 1 THEN 'original' ELSE 'preview' END AS role,
  pass = 1 AND bool_or(thumb = 0) OVER (PARTITION BY root) AS is_ambiguous FROM vg0 JOIN vid USING (path))"""]
    return parts


def _video_sql(s) -> str:
    return o.with_(o.FEAT.lstrip(), VIDEO, *_video_parts(s)) + "SELECT * FROM vg"


def _video_query(name: str, s):
    @register(name, _video_sql(s))
    def run(spark, sf_dir):
        found = videos.find_video_groups(_videos(spark, sf_dir), s)
        return found.select("group_id", "image_id", "role", "is_ambiguous")


_video_query("video_groups", SETTINGS)
_video_query("video_groups_any_container", SETTINGS.with_(video_match_format=False))
_video_query("video_groups_by_content", SETTINGS.with_(video_match_format=False, video_match_size=False))


@register("video_groups_guarded", _video_sql(SETTINGS.with_(video_match_format=False)))
def video_groups_guarded(spark, sf_dir):
    """With neither container nor size asked for, the scan switches size on."""
    s = videos.require_a_criterion(SETTINGS.with_(video_match_format=False, video_match_size=False))
    return videos.find_video_groups(_videos(spark, sf_dir), s).select("group_id", "image_id", "role", "is_ambiguous")


@register("all_groups", o.with_(*o.grouped(), VIDEO.lstrip(), *_video_parts(SETTINGS)) + """
SELECT 'image' AS media, group_id, image_id, role FROM roles UNION ALL SELECT 'video', group_id, image_id, role FROM vg""")
def all_groups(spark, sf_dir):
    """Image groups next to all video groups."""
    found = videos.find_video_groups(_videos(spark, sf_dir), SETTINGS)
    both = groups.with_video_groups(default_groups(spark, sf_dir), found)
    return both.select("media", "group_id", "image_id", "role")


@register("video_cache_update", FEAT + """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM feat WHERE doc_id % 10 <> 1""")
def video_cache_update(spark, sf_dir):
    v = _videos(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"clip_(\d+)", 1).cast("long"))
    old = v.withColumn("state", F.lit("old")).withColumn(
        "duration", F.when(F.col("doc_id") % 4 != 0, F.col("duration")))
    listing = v.filter("doc_id % 10 <> 1")
    again = videos.needs_content(old).select("path").join(listing, "path").withColumn("state", F.lit("new"))
    return cache.update_video_cache(old, listing, again).select("doc_id", "state")


# Cache and folders --------------------------------------------------------------------------------

def _cached(spark, sf_dir) -> DataFrame:
    """An earlier cache: some files missing, some changed since, some RAW rows read in the other mode."""
    f = kept_features(spark, sf_dir).filter("doc_id % 4 <> 0")
    return f.withColumns({
        "mtime": F.when(F.col("doc_id") % 6 == 1, F.timestamp_seconds(F.lit(0))).otherwise(F.col("mtime")),
        "hash_mode": F.when(F.col("doc_id") % 20 == 18, "").otherwise(F.col("hash_mode")),
    })


STALE = "(doc_id % 4 = 0 OR doc_id % 6 = 1 OR (is_raw AND doc_id % 20 = 18))"


@register("files_to_read", FEAT + f"SELECT image_id FROM feat WHERE {STALE}")
def files_to_read(spark, sf_dir):
    return cache.split_by_cache(kept_features(spark, sf_dir), _cached(spark, sf_dir))[1].select("image_id")


@register("files_to_read_trusted", FEAT + """
SELECT image_id FROM feat WHERE doc_id % 4 = 0 OR (is_raw AND doc_id % 20 = 18)""")
def files_to_read_trusted(spark, sf_dir):
    return cache.split_by_cache(kept_features(spark, sf_dir), _cached(spark, sf_dir), trust=True)[1].select("image_id")


@register("refreshed_features", FEAT + f"SELECT image_id, phash, CASE WHEN {STALE} THEN 'read' ELSE 'cache' END AS origin FROM feat")
def refreshed_features(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    cached = _cached(spark, sf_dir).withColumn("origin", F.lit("cache"))
    return cache.refresh(f, cached, lambda m: m.withColumn("origin", F.lit("read"))).select("image_id", "phash", "origin")


@register("cache_status", FEAT + f"""
SELECT root, count(*) AS total, count(*) FILTER {f'({STALE})'} AS stale FROM feat GROUP BY root""")
def cache_status(spark, sf_dir):
    return cache.cache_status(kept_features(spark, sf_dir), _cached(spark, sf_dir), "root")


@register("cache_of_folder", FEAT + """
SELECT image_id, CASE WHEN doc_id % 2 = 0 THEN root ELSE '/lib' END AS cache_root FROM feat
WHERE source = 'src2' AND (doc_id % 2 = 0 OR doc_id % 3 = 0)""")
def cache_of_folder(spark, sf_dir):
    f = kept_features(spark, sf_dir).select("image_id", "doc_id", "root")
    rows = f.filter("doc_id % 2 = 0").withColumn("cache_root", F.col("root")).union(
        f.filter("doc_id % 3 = 0").withColumn("cache_root", F.lit("/lib"))).union(
        f.withColumn("cache_root", F.lit("/lib/src1")))
    tracked = rows.select(F.col("cache_root").alias("path")).distinct()
    return cache.merged_cache(rows, tracked, "/lib/src2").select("image_id", "cache_root")


@register("nearest_folder", FEAT + """
SELECT image_id, CASE WHEN lang = 'en' THEN dir WHEN source IN ('src1', 'src2') THEN root ELSE '/lib' END AS folder FROM feat""")
def nearest_folder(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    listed = f.filter("dir like '%/en'").select("dir").union(
        f.filter("root in ('/lib/src1', '/lib/src2')").select("root")).union(f.select(F.lit("/lib"))).distinct()
    return folders.nearest_ancestor(f.select("image_id"), "image_id", listed.withColumnRenamed("dir", "folder"))


@register("uncovered_folders", FEAT + """
SELECT DISTINCT root AS path FROM feat WHERE source <> 'src5' UNION SELECT DISTINCT dir FROM feat WHERE source = 'src5'""")
def uncovered_folders(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    listed = f.select(F.col("dir").alias("path")).union(f.filter("root <> '/lib/src5'").select("root")).distinct()
    return folders.drop_covered(listed)


def _quarter(k: int) -> str:
    return f"sum(('0x' || substr(sha256(name), {1 + 16 * k}, 16))::UBIGINT::HUGEINT)::VARCHAR"


@register("folder_fingerprints", FEAT + f"""
SELECT dir, sha256(concat_ws(':', count(*)::VARCHAR, {', '.join(_quarter(k) for k in range(4))})) AS fingerprint
FROM (SELECT DISTINCT dir, name FROM feat) GROUP BY dir""")
def folder_fingerprints(spark, sf_dir):
    return folders.folder_fingerprints(kept_features(spark, sf_dir))


@register("first_names_fingerprints", FEAT + """
SELECT dir, sha256(string_agg(name, chr(10) ORDER BY name)) AS fingerprint
FROM (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) AS n FROM feat) WHERE n <= 50 GROUP BY dir""")
def first_names_fingerprints(spark, sf_dir):
    return folders.first_names_fingerprints(kept_features(spark, sf_dir))


@register("moved_folder", FEAT + """
SELECT CASE WHEN source = 'src1' THEN '/new/place' || substr(image_id, 10) ELSE image_id END AS image_id, doc_id FROM feat""")
def moved_folder(spark, sf_dir):
    return cache.remap_folder(kept_features(spark, sf_dir).select("image_id", "doc_id"), ["image_id"], "/lib/src1", "/new/place")


@register("raw_companions", FEAT + """
, f2 AS (SELECT image_id, ext, dir, doc_id // 2 AS pair FROM feat),
raws AS (SELECT dir, pair, max(image_id) AS raw FROM f2 WHERE ext = '.cr2' GROUP BY ALL),
last AS (SELECT dir, pair, max(image_id) AS image_id FROM f2 WHERE ext <> '.cr2' GROUP BY ALL)
SELECT f2.image_id, coalesce(raw, '') AS companion FROM f2 LEFT JOIN (SELECT * FROM last JOIN raws USING (dir, pair)) p
  USING (image_id)""")
def raw_companions(spark, sf_dir):
    f = kept_features(spark, sf_dir).withColumn("stem", F.concat(F.lit("S"), F.floor(F.col("doc_id") / 2).cast("string")))
    listing = f.withColumn("path", F.col("image_id"))
    out = folders.attach_raw_companions(f.drop("companions"), listing)
    return out.select("image_id", F.array_join("companions", ";").alias("companion"))


@register("sidecar_files", FEAT + """
SELECT image_id AS path, dir || '/' || stem || x AS sidecar FROM feat, (VALUES (4, '.xmp'), (6, '.AAE')) v(e, x)
WHERE doc_id % e = 0""")
def sidecar_files(spark, sf_dir):
    files = kept_features(spark, sf_dir).select(F.col("image_id").alias("path"), "dir", "stem")
    return folders.sidecars(files, _listing(spark, sf_dir))


@register("stored_results", GROUPED + """
SELECT coalesce(role, 'solo') AS role, count(*) AS n, sum(file_size)::BIGINT AS bytes, count(exif_s) AS dated
FROM featm LEFT JOIN (SELECT image_id, role FROM roles) USING (image_id) GROUP BY ALL""")
def stored_results(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    folder = stored(spark, "results")
    broken = f.filter("width < 0").select(F.col("image_id").alias("path"), "file_size")
    tables.save_results(default_groups(spark, sf_dir), f, broken, folder, "scan1")
    return tables.load_results(spark, folder, "scan1").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"), F.count("exif_date").alias("dated"))


@register("stored_features", FEAT + """
SELECT '/lib/' || source AS cache_root, image_id, phash, file_size, mtime_s FROM feat
WHERE source IN ('src1', 'src2') AND (source <> 'src2' OR doc_id % 2 = 0)""")
def stored_features(spark, sf_dir):
    """A cache of three folders: one is replaced by a part of itself, read from the cache, and one by nothing."""
    f = kept_features(spark, sf_dir)
    place = stored(spark, "features")
    for k in (1, 2, 3):
        tables.save_feature_cache(f.filter(f"root = '/lib/src{k}'").drop("doc_id", "root"), place, f"/lib/src{k}")
    half = tables.load_feature_cache(spark, place, "/lib/src2").join(
        f.filter("doc_id % 2 = 0").select("image_id"), "image_id", "left_semi")
    tables.save_feature_cache(half.drop("cache_root"), place, "/lib/src2")
    tables.save_feature_cache(half.drop("cache_root").filter("false"), place, "/lib/src3")
    return tables.load_feature_cache(spark, place).select(
        "cache_root", "image_id", "phash", "file_size", F.unix_timestamp("mtime").alias("mtime_s"))


@register("stored_videos", o.with_(o.FEAT.lstrip(), VIDEO) + """
SELECT CASE WHEN ext = '.mp4' THEN '/vid/a' ELSE '/vid/b' END AS cache_root, path, size, mtime_s, thumb AS phash, duration,
  array_to_string(frames, ',') AS frames FROM vid WHERE ext = '.mp4' OR doc_id % 3 <> 0""")
def stored_videos(spark, sf_dir):
    v = _videos(spark, sf_dir)
    place = stored(spark, "videos")
    first, second = v.filter("path like '%.mp4'"), v.filter("path like '%.mov'")
    tables.save_video_cache(first, place, "/vid/a")
    tables.save_video_cache(second, place, "/vid/b")
    number = F.regexp_extract("path", r"clip_(\d+)", 1).cast("long")
    again = tables.load_video_cache(spark, place, "/vid/b").filter(number % 3 != 0)
    tables.save_video_cache(again.drop("cache_root"), place, "/vid/b")
    return tables.load_video_cache(spark, place).select(
        "cache_root", "path", "size", F.unix_timestamp("mtime").alias("mtime_s"), "phash", "duration",
        F.array_join(F.transform("frame_hashes", lambda h: h.cast("string")), ",").alias("frames"))


@register("stored_manifest", GROUPED + """
SELECT run_id, image_id AS from_path, '/out/trash/' || name AS to_path, 'planned' AS status, group_id
FROM roles, (VALUES ('first'), ('second')) r(run_id) WHERE role = 'preview' AND doc_id % 9 <> 0 UNION ALL
SELECT 'first', image_id, '', 'skipped: file not found', group_id FROM roles WHERE role = 'preview' AND doc_id % 9 = 0""")
def stored_manifest(spark, sf_dir):
    ops = trash_manifest(spark, sf_dir)
    place = stored(spark, "manifest")
    tables.append_manifest(ops, place, "first")
    tables.append_manifest(ops.filter("status = 'planned'"), place, "second")
    both = tables.load_manifest(spark, place, "first").unionByName(tables.load_manifest(spark, place, "second"))
    return both.select("run_id", "from_path", "to_path", "status", "group_id")


@register("stored_history", GROUPED + """
SELECT src, (SELECT count(*) FROM featm) AS total_files, count(DISTINCT group_id) AS groups,
  count(*) FILTER (role = 'preview') AS duplicates FROM roles, (VALUES ('/lib'), ('/again')) s(src) GROUP BY src""")
def stored_history(spark, sf_dir):
    totals = summary.scan_summary(default_groups(spark, sf_dir), kept_features(spark, sf_dir))
    place = stored(spark, "history")
    for source in ("/lib", "/again"):
        tables.append_history(summary.history_row(totals, source), place)
    return tables.load_history(spark, place).select(F.col("src_folder").alias("src"), "total_files", "groups", "duplicates")


@register("stored_folders", FEAT + """
SELECT path, n AS file_count FROM (SELECT dir AS path, count(*) AS n FROM feat GROUP BY dir)
WHERE path NOT LIKE '/lib/src1/%' AND path <> '/lib/src1' AND path NOT LIKE '/lib/src2/%' AND path <> '/lib/src2'
UNION ALL SELECT '/lib/src2', 0""")
def stored_folders(spark, sf_dir):
    """The index is saved, folders are dropped from it and one is added above others, each step over its own file."""
    f = kept_features(spark, sf_dir)
    place = stored(spark, "folders")
    blank = [F.lit("").alias(c) for c in ("drive_type", "volume_serial", "folder_fingerprint")]
    entry = lambda df: df.select("path", *blank, F.lit(None).cast("timestamp").alias("last_updated"), "file_count")
    tables.save_tracked_folders(entry(f.groupBy(F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("file_count"))), place)
    index = tables.load_tracked_folders(spark, place)
    gone = index.filter("path like '/lib/src1/%' or path = '/lib/src1'")
    tables.save_tracked_folders(tables.without_folder(index, gone), place)
    new = entry(spark.range(1).select(F.lit("/lib/src2").alias("path"), F.lit(0).cast("long").alias("file_count")))
    tables.save_tracked_folders(tables.set_folder(tables.load_tracked_folders(spark, place), new), place)
    return tables.load_tracked_folders(spark, place).select("path", "file_count")


@register("csv_export", GROUPED + """
SELECT group_id, is_series, role, name AS filename, image_id AS path, width, height, width::BIGINT * height AS pixels,
  round(file_size / 1024.0, 1) AS file_size_kb, mtime_s::DOUBLE AS mtime,
  round(brightness, 2) AS brightness, 'Maker ' || doc_id % 5 AS camera_make,
  CASE WHEN doc_id % 4 <> 0 THEN 'Model ' || doc_id % 7 ELSE '' END AS camera_model,
  CASE WHEN doc_id % 6 = 0 THEN 'Prime' WHEN doc_id % 2 = 0 THEN 'Zoom' ELSE '' END AS lens_model,
  ((doc_id % 8 + 1) * 100)::VARCHAR AS iso, printf('f/%.1f', (doc_id % 7 + 2) / 2.0) AS aperture,
  CASE WHEN doc_id % 9 = 0 THEN 'fast' WHEN 2.0 / (doc_id % 50 + 1) < 1 THEN
    '1/' || round_even(1 / (1.0::DOUBLE / (doc_id % 50 + 1) * 2), 0)::BIGINT || 's'
    ELSE printf('%.1fs', 1.0::DOUBLE / (doc_id % 50 + 1) * 2) END AS shutter_speed,
  (doc_id % 90 + 10) || 'mm' AS focal_length,
  CASE WHEN doc_id % 3 <> 0 THEN strftime(make_timestamp(mtime_s * 1000000), '%Y:%m:%d %H:%M:%S') ELSE '' END AS date_taken,
  '' AS gps_lat, '' AS gps_lon FROM roles""")
def csv_export(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    rows = tables.csv_rows(default_groups(spark, sf_dir), f, _exif(f).drop("doc_id"))
    return rows.drop("metadata_count", "companions")  # constant in the derived features


@register("group_documents", GROUPED + """
SELECT group_id, ((row_number() OVER (PARTITION BY group_id ORDER BY image_id) - 1) // 1000)::INT AS part, is_series, role,
  image_id AS path, name AS filename, width, height, file_size, mtime_s::DOUBLE AS mtime, round(brightness, 2) AS brightness FROM roles""")
def group_documents(spark, sf_dir):
    docs = tables.group_documents(default_groups(spark, sf_dir), kept_features(spark, sf_dir))
    fields = ["path", "filename", "width", "height", "file_size", "mtime", "brightness"]
    of = lambda role: docs.select("group_id", "part", "is_series", F.lit(role).alias("role"), F.explode(f"{role}s").alias("d"))
    every = of("original").union(of("preview"))
    return every.select("group_id", "part", "is_series", "role", *[F.col(f"d.{c}").alias(c) for c in fields])


# Calibration --------------------------------------------------------------------------------------

TRUTH = """
txt AS (SELECT doc_id, image_id, file_size, width, height, md5(text) AS label, count(*) OVER (PARTITION BY md5(text)) AS n FROM feat),
truth0 AS (
  SELECT 'groups' AS kind, label, image_id AS path FROM txt WHERE n >= 2 UNION ALL
  SELECT 'negatives', 'n' || doc_id // 2, image_id FROM txt WHERE n = 1 AND doc_id // 2 IN
    (SELECT doc_id // 2 FROM txt WHERE n = 1 GROUP BY 1 HAVING count(*) >= 2) UNION ALL
  SELECT 'singles', NULL, image_id FROM txt WHERE n = 1 AND doc_id % 3 = 0)"""


def _truth(spark, sf_dir) -> DataFrame:
    """Equal texts are groups, neighbours with unequal texts are negatives, every third unique text is a single."""
    def build() -> DataFrame:
        f = kept_features(spark, sf_dir)
        d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("label"))
        n = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        rows = f.select("image_id", "doc_id", "file_size").join(d, "doc_id").join(n, "label")
        base = F.lit("/truth/")
        sets = rows.filter("n >= 2").select("image_id", "file_size", F.concat(base, F.lit("groups/"), "label", F.lit("/")).alias("at"))
        alone = rows.filter("n = 1")
        pairs = alone.select("image_id", "file_size", F.concat(
            base, F.lit("negatives/n"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("/")).alias("at"))
        singles = alone.filter("doc_id % 3 = 0").select("image_id", "file_size", F.concat(base, F.lit("singles/")).alias("at"))
        every = sets.union(pairs).union(singles)
        # The file name carries the whole library path, so one folder can hold files of many.
        return every.select(
            F.concat("at", F.replace(F.col("image_id"), F.lit("/"), F.lit("|"))).alias("path"), "file_size",
            paths.extension(F.col("image_id")).alias("ext"))
    listing = kept(spark, sf_dir, "truth", build)
    truth = ground_truth.load_ground_truth(listing, "/truth")
    return truth.withColumn("path", F.replace(paths.file_name(F.col("path")), F.lit("|"), F.lit("/")))


@register("ground_truth", o.with_(o.FEAT.lstrip(), TRUTH) + "SELECT kind, label, path FROM truth0")
def load_truth(spark, sf_dir):
    return _truth(spark, sf_dir).select("kind", "label", "path")


@register("ground_truth_check", o.with_(o.FEAT.lstrip(), TRUTH) + """
SELECT count(DISTINCT label) FILTER (kind = 'groups') AS groups, count(DISTINCT label) FILTER (kind = 'negatives') AS negatives,
  count(*) FILTER (kind = 'singles') AS singles, count(DISTINCT label) FILTER (kind = 'groups') > 0 AS is_valid FROM truth0""")
def ground_truth_check(spark, sf_dir):
    return ground_truth.validate_ground_truth(_truth(spark, sf_dir))


@register("expected_originals", o.with_(o.FEAT.lstrip(), TRUTH) + """
SELECT label, path FROM (SELECT label, image_id AS path, row_number() OVER (PARTITION BY label
  ORDER BY -(width::BIGINT * height), -file_size, image_id) AS k FROM txt WHERE n >= 2) WHERE k = 1""")
def expected_originals(spark, sf_dir):
    refined = ground_truth.refine_originals(_truth(spark, sf_dir), kept_features(spark, sf_dir))
    return refined.filter("is_original").select("label", "path")


SCORE = """
tr AS (SELECT t.*, t.kind = 'groups' AND row_number() OVER (PARTITION BY t.kind, t.label
    ORDER BY -(f.width::BIGINT * f.height), -f.file_size, f.image_id) = 1 AS is_original, f.width::BIGINT * f.height AS px, f.file_size,
    r.group_id, r.role FROM truth0 t JOIN featm f ON f.image_id = t.path LEFT JOIN roles r ON r.image_id = t.path),
bo AS (SELECT group_id, max(struct_pack(p := width::BIGINT * height, s := file_size)) AS best FROM roles WHERE role = 'original' GROUP BY 1),
gs AS (SELECT label, count(DISTINCT group_id) AS ids, min(group_id) AS group_id, count(group_id) AS seen, count(*) AS files,
    bool_or(is_original AND role = 'original') AS hit,
    max(struct_pack(p := px, s := file_size)) FILTER (is_original AND group_id IS NOT NULL) AS exp_size,
    count(*) FILTER (NOT is_original) AS expected, count(*) FILTER (NOT is_original AND role = 'preview') AS got
  FROM tr WHERE kind = 'groups' GROUP BY label),
g AS (SELECT count(*) AS groups_total, count(*) FILTER (ids = 1) AS groups_found, count(*) FILTER (ids = 1 AND seen = files) AS groups_strict,
    count(*) FILTER (ids = 1 AND (coalesce(hit, false) OR coalesce(best >= exp_size, false))) AS originals_correct,
    sum(expected)::BIGINT AS previews_total, coalesce(sum(got) FILTER (ids = 1), 0)::BIGINT AS previews_correct
  FROM gs LEFT JOIN bo USING (group_id)),
s AS (SELECT count(*) AS singles_total, count(group_id) AS false_positives FROM tr WHERE kind = 'singles'),
n AS (SELECT count(*) AS negatives_total, count(*) FILTER (NOT bad) AS negatives_correct FROM (
    SELECT label, bool_or(k > 1) AS bad FROM (SELECT label, group_id, count(group_id) AS k FROM tr WHERE kind = 'negatives' GROUP BY ALL) GROUP BY label))"""
SCORE_SELECT = """
SELECT g.*, s.*, n.*, round((groups_found * 2 + originals_correct + previews_correct + singles_total - false_positives
    + negatives_correct * 3) / (groups_total * 3 + previews_total + singles_total + negatives_total * 3), 9) AS score,
  round(2.0 * groups_found / (2 * groups_found + (groups_total - groups_found) + false_positives + negatives_total - negatives_correct), 9) AS f1,
  (SELECT count(DISTINCT group_id) FROM roles) AS n_groups FROM g, s, n"""
DEFAULT_COMBO = f"SELECT * EXCLUDE (n_groups) FROM ({o.with_(*o.grouped(), TRUTH, SCORE)} {SCORE_SELECT})"


@register("calibration_score", DEFAULT_COMBO)
def calibration_score(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    refined = ground_truth.refine_originals(_truth(spark, sf_dir), f)
    found = default_groups(spark, sf_dir).withColumn("combo_id", F.lit(0))
    out = calibrate.score(refined, found, f, 1).drop("combo_id")
    return out.withColumns({c: F.round(c, 9) for c in ("score", "f1")})


def _combos_sql(combos, columns: str) -> str:
    """The score of several configurations, numbered in order."""
    return " UNION ALL ".join(
        f"SELECT {i} AS combo_id, {columns} FROM ({o.with_(*o.grouped(c), TRUTH, SCORE)} {SCORE_SELECT})"
        for i, c in enumerate(combos)
    )


TWO = [SETTINGS.with_(threshold=4, preview_ratio=0.8), WIDE.with_(preview_ratio=0.95, dark_protection=False)]


@register("calibration_of_two", _combos_sql(TWO, "groups_found, groups_strict, originals_correct, previews_correct, "
                                            "false_positives, negatives_correct, score, f1, n_groups"))
def calibration_of_two(spark, sf_dir):
    scored = calibrate.score_settings(kept_features(spark, sf_dir), _truth(spark, sf_dir), TWO)
    return scored.select("combo_id", "groups_found", "groups_strict", "originals_correct", "previews_correct",
                         "false_positives", "negatives_correct", F.round("score", 9).alias("score"),
                         F.round("f1", 9).alias("f1"), "n_groups")


GRID = [SETTINGS.with_(threshold=t, preview_ratio=r, series_threshold_factor=1.0)
        for t in calibrate.ROUND1_THRESHOLDS for r in calibrate.ROUND1_RATIOS]


def _labelled_components(s) -> str:
    return o.components(s).lstrip().replace("FROM feat WHERE", "FROM feat WHERE image_id IN (SELECT path FROM truth0) AND", 1)


def _scores_sql(combos, columns: str) -> str:
    """Scores of configurations over the labelled files, numbered in order; those alike in all but the preview ratio share
    their components."""
    shared: dict = {}
    for i, c in enumerate(combos):
        shared.setdefault(c.with_(preview_ratio=0.0, disable_series_detection=False), []).append((i, c))
    parts = []
    for s, own in shared.items():
        inner = " UNION ALL ".join(
            f"SELECT {i} AS combo_id, {columns} FROM ({o.with_(o.roles(c).lstrip(), SCORE)} {SCORE_SELECT})" for i, c in own)
        parts.append(f"SELECT * FROM ({o.with_(o.FEAT.lstrip(), TRUTH, _labelled_components(s))} {inner})")
    return " UNION ALL ".join(parts)


SCORED = "groups_found, groups_strict, originals_correct, previews_correct, false_positives, negatives_correct, score, f1, n_groups"


@register("calibration_grid", f"SELECT *, row_number() OVER (ORDER BY score DESC, combo_id)::INT AS rank FROM ({_scores_sql(GRID, SCORED)})")
def calibration_grid(spark, sf_dir):
    """The coarse grid of the first calibration round: every threshold with every ratio, over the labelled files."""
    truth = _truth(spark, sf_dir)
    scored = calibrate.score_settings(calibrate.labelled(kept_features(spark, sf_dir), truth), truth, GRID)
    columns = [c for c in SCORED.split(", ") if c not in ("score", "f1")]
    rows = scored.select("combo_id", *columns, F.round("score", 9).alias("score"), F.round("f1", 9).alias("f1"))
    return summary.top_rows(rows, "score", n=len(GRID))


CORPORA = [s.with_(series_threshold_factor=1.0) for s in (SETTINGS, SETTINGS.with_(threshold=4), SETTINGS.with_(threshold=8),
                                                          SETTINGS.with_(threshold=8, preview_ratio=0.8))]


def _corpora_sql() -> str:
    """Every corpus scored apart, its files being all there is; the best three configurations of each."""
    parts = []
    for name, where in (("early", "= 9"), ("late", "<> 9")):
        own = (TRUTH.replace("truth0 AS (", "every_truth AS (", 1)
               + f",\ntruth0 AS (SELECT t.* FROM every_truth t JOIN feat f ON f.image_id = t.path WHERE length(f.root) {where})")
        for i, c in enumerate(CORPORA):
            parts.append(f"SELECT '{name}' AS corpus, {i} AS combo_id, {SCORED} FROM ("
                         + o.with_(o.FEAT.lstrip(), own, _labelled_components(c), o.roles(c).lstrip(), SCORE) + f"{SCORE_SELECT})")
    return " UNION ALL ".join(parts)


@register("calibration_of_corpora", f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, combo_id)::INT AS rank FROM ({_corpora_sql()})) WHERE rank <= 3""")
def calibration_of_corpora(spark, sf_dir):
    """Two corpora by source folder (the first ten and the rest), scored in one pass: the best three configurations of each, with F1."""
    corpus = F.when(F.length("root") == 9, "early").otherwise("late")
    truth = _truth(spark, sf_dir)
    f = calibrate.labelled(kept_features(spark, sf_dir), truth).withColumn("corpus", corpus)
    scored = calibrate.score_settings(f, truth, CORPORA, "corpus")
    columns = [c for c in SCORED.split(", ") if c not in ("score", "f1")]
    rows = scored.select("corpus", "combo_id", *columns, F.round("score", 9).alias("score"), F.round("f1", 9).alias("f1"))
    return summary.top_rows(rows, "score", "corpus", 3)


@register("guard_ablation", "WITH scores AS (" + _combos_sql(
    [SETTINGS.with_(**c) for c in calibrate.ABLATION.values()], "score, n_groups") + """)
SELECT combo_id, score, n_groups, round((score - (SELECT score FROM scores WHERE combo_id = 0)) * 100, 6) AS accuracy_delta
FROM scores""")
def guard_ablation(spark, sf_dir):
    rows = calibrate.ablation(kept_features(spark, sf_dir), _truth(spark, sf_dir), SETTINGS)
    return rows.select("combo_id", F.round("score", 9).alias("score"), "n_groups",
                       F.round("accuracy_delta", 6).alias("accuracy_delta"))


def _variant_sql() -> str:
    """The scores of all variants; without metadata no file has an EXIF date."""
    parts = []
    for i, (name, changes, meta) in enumerate(calibrate.VARIANTS):
        feat, *rest = o.grouped(SETTINGS.with_(**changes))
        if not meta:
            feat = feat.replace("CASE WHEN doc_id % 3 <> 0 THEN 1704067200 + doc_id * 60 END AS exif_s", "NULL::BIGINT AS exif_s")
        parts.append(f"SELECT {i} AS combo_id, '{name}' AS variant, {meta} AS metadata, score, n_groups FROM ({o.with_(feat, *rest, TRUTH, SCORE)} {SCORE_SELECT})")
    return f"""scores AS MATERIALIZED ({" UNION ALL ".join(parts)}),
deltas AS (SELECT *, round((score - (SELECT score FROM scores WHERE combo_id = 0)) * 100, 6) AS accuracy_delta FROM scores)"""


def _variants(spark, sf_dir) -> DataFrame:
    rows = kept(spark, sf_dir, "variants", lambda: calibrate.variant_scores(kept_features(spark, sf_dir), _truth(spark, sf_dir), SETTINGS))
    return rows.withColumns({"score": F.round("score", 9), "accuracy_delta": F.round("accuracy_delta", 6)})


@register("ablation_variants", "WITH " + _variant_sql() + " SELECT * FROM deltas")
def ablation_variants(spark, sf_dir):
    return _variants(spark, sf_dir)


@register("speed_tiers", "WITH " + _variant_sql() + f""",
tiers(tier, max_loss) AS (VALUES {", ".join(map(str, calibrate.SPEED_TIERS))})
SELECT tier, max_loss::DOUBLE AS max_loss, max_by(variant, combo_id) AS variant, round(12.0 / (12.0 - max(combo_id)), 6)::DOUBLE AS speedup
FROM deltas JOIN tiers ON accuracy_delta >= max_loss GROUP BY tier, max_loss""")
def speed_tiers(spark, sf_dir):
    """The fastest variant within each loss, at fixed times: every variant a second faster than the one before."""
    timed = _variants(spark, sf_dir).withColumns({"seconds": F.lit(12.0) - F.col("combo_id"), "base_seconds": F.lit(12.0)})
    return calibrate.speed_tiers(timed).withColumn("speedup", F.round("speedup", 6))


@register("calibration_rounds")
def calibration_rounds(spark, sf_dir):
    """All four rounds; one row per configuration tried."""
    done = calibrate.run_calibration(kept_features(spark, sf_dir), _truth(spark, sf_dir), SETTINGS)
    rows = [(r["round"], r["threshold"], r["preview_ratio"], r["label"], r["score"], r["f1"], r is done.best)
            for r in done.rows]
    return spark.createDataFrame(
        rows, "round int, threshold int, preview_ratio double, label string, score double, f1 double, is_best boolean")


def _diagnosis_sql() -> str:
    chain = " ".join(f"WHEN NOT ({g}) THEN '{k}'" for k, g in o.guards(SETTINGS).items())
    return f"""
tr AS (SELECT t.*, row_number() OVER (PARTITION BY t.kind, t.label ORDER BY
    CASE WHEN t.kind = 'groups' THEN -(f.width::BIGINT * f.height) ELSE 0 END,
    CASE WHEN t.kind = 'groups' THEN -f.file_size ELSE 0 END, f.image_id) AS n FROM truth0 t JOIN featm f ON f.image_id = t.path
    WHERE kind <> 'singles'),
diag AS (SELECT kind, label, ia AS path_a, ib AS path_b, round(ar_diff * 100, 6) AS ar_diff_pct, dist AS phash_dist, dd AS dhash_dist,
    round(sim, 6) AS hist_sim, same_dims, thr::INT AS effective_threshold, CASE {chain} END AS blocked_by
  FROM (SELECT {o.pair_columns(SETTINGS)}, x.kind, x.label FROM tr x JOIN tr y ON x.kind = y.kind AND x.label = y.label AND x.n = 1 AND y.n > 1
    JOIN featm a ON a.image_id = x.path JOIN featm b ON b.image_id = y.path))"""


def _diagnosis(spark, sf_dir) -> DataFrame:
    f = kept_features(spark, sf_dir)
    refined = ground_truth.refine_originals(_truth(spark, sf_dir), f)
    return calibrate.diagnose_pairs(f, refined, default_groups(spark, sf_dir), SETTINGS, "original")


@register("guard_diagnosis", o.with_(*o.grouped(), TRUTH, _diagnosis_sql()) + "SELECT * FROM diag")
def guard_diagnosis(spark, sf_dir):
    return _diagnosis(spark, sf_dir).select(
        "kind", "label", "path_a", "path_b", F.round("ar_diff_pct", 6).alias("ar_diff_pct"), "phash_dist", "dhash_dist",
        F.round("hist_sim", 6).alias("hist_sim"), "same_dims", "effective_threshold", "blocked_by")


@register("blocking_guards", o.with_(*o.grouped(), TRUTH, _diagnosis_sql(), """
missed AS (SELECT label FROM truth0 t LEFT JOIN roles r ON r.image_id = t.path WHERE kind = 'groups' GROUP BY label
  HAVING count(DISTINCT group_id) <> 1)""") + """
SELECT blocked_by, count(*) AS pairs, CASE blocked_by """ + " ".join(
    f"WHEN '{guard}' THEN '{text}'" for guard, text in calibrate.GUARD_ADVICE.items()) + """ ELSE '' END AS advice
FROM diag WHERE kind = 'groups' AND blocked_by IS NOT NULL AND label IN (SELECT label FROM missed) GROUP BY 1""")
def blocking_guards(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    refined = ground_truth.refine_originals(_truth(spark, sf_dir), f)
    sets = calibrate.diagnose_groups(refined, default_groups(spark, sf_dir))
    return calibrate.blocking_guards(_diagnosis(spark, sf_dir), sets).select("blocked_by", "pairs", "advice")


@register("diagnosed_negatives", o.with_(*o.grouped(), TRUTH) + """
SELECT label, sum(k * (k - 1) // 2)::BIGINT AS merged_pairs, sum(k * (k - 1) // 2) > 0 AS wrongly_merged FROM (
  SELECT label, group_id, count(group_id) AS k FROM truth0 t LEFT JOIN roles r ON r.image_id = t.path
  WHERE kind = 'negatives' GROUP BY ALL) GROUP BY label""")
def diagnosed_negatives(spark, sf_dir):
    return calibrate.diagnose_negatives(_truth(spark, sf_dir), default_groups(spark, sf_dir))


@register("diagnosed_singles", o.with_(*o.grouped(), TRUTH) + f"""
SELECT t.path AS path_a, min({o.ham('a.phash', 'b.phash')}) AS nearest FROM truth0 t JOIN roles a ON a.image_id = t.path
JOIN roles b ON a.group_id = b.group_id AND a.image_id <> b.image_id WHERE t.kind = 'singles' GROUP BY 1""")
def diagnosed_singles(spark, sf_dir):
    f = kept_features(spark, sf_dir)
    rows = calibrate.diagnose_singles(f, _truth(spark, sf_dir), default_groups(spark, sf_dir), SETTINGS)
    h = f.select("image_id", "phash")
    both = rows.join(h.withColumnsRenamed({"image_id": "path_a", "phash": "pa"}), "path_a").join(
        h.withColumnsRenamed({"image_id": "path_b", "phash": "pb"}), "path_b")
    return both.select("path_a", F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))).alias("nearest"))
