"""Text labels for sizes, dimensions, dates and durations, and EXIF field formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.config import SKIPPED_EXIF_TAGS

MIB = 1024 * 1024


def size_label(size: Column) -> Column:
    mb = size / F.lit(MIB)
    return F.when(mb >= 1, F.format_string("%.2f MB", mb)).otherwise(
        F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB"))
    )


def dimension_label(width: Column, height: Column, is_video: Column) -> Column:
    mp = width.cast("long") * height / F.lit(1_000_000)
    return F.when(is_video, F.lit("Video")).otherwise(F.format_string("%dx%d  (%.1f MP)", width, height, mp))


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("Unknown date"))


def bytes_label(size: Column) -> Column:
    mb = size / F.lit(MIB)
    return (
        F.when(mb >= 1024, F.format_string("%.1f GB", mb / 1024))
        .when(mb >= 1, F.format_string("%.1f MB", mb))
        .when(size > 0, F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB")))
        .otherwise(F.lit("–"))
    )


def duration_label(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    )


def exif_field_count(tags: Column) -> Column:
    """Fields that hold something."""
    return F.coalesce(F.size(F.map_filter(tags, lambda k, v: v.isNotNull() & (v != ""))), F.lit(0))


def exif_listing(tags: Column) -> Column:
    """Sorted ``(tag, value)`` pairs without the binary tags; values are whole, a display may cut them."""
    kept = F.map_filter(tags, lambda k, v: ~k.isin(SKIPPED_EXIF_TAGS))
    return F.array_sort(
        F.transform(
            F.map_entries(kept),
            lambda e: F.struct(e["key"].alias("tag"), e["value"].alias("value")),
        )
    )


def _numeric(tags: Column, tag: str, shown) -> Column:
    """A tag shown as a formatted number, or as its own text when it is no number; empty when absent."""
    text = F.try_element_at(tags, F.lit(tag))
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | (text == "") | (number == 0), F.lit(""))
        .when(number.isNotNull(), shown(number))
        .otherwise(text)
    )


def exif_aperture(tags: Column) -> Column:
    return _numeric(tags, "FNumber", lambda v: F.format_string("f/%.1f", v))


def exif_shutter(tags: Column) -> Column:
    return _numeric(
        tags,
        "ExposureTime",
        lambda v: F.when(v < 1, F.concat(F.lit("1/"), F.bround(1 / v).cast("long").cast("string"), F.lit("s")))
        .otherwise(F.format_string("%.1fs", v)),
    )


def exif_focal(tags: Column) -> Column:
    return _numeric(tags, "FocalLength", lambda v: F.concat(F.bround(v).cast("long").cast("string"), F.lit("mm")))


def exif_text(tags: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names], F.lit(""))
