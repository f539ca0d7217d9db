"""Capture dates from EXIF text, file names and modification times."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text forms and the order tags are tried in.
EXIF_FORMATS = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
EXIF_TAGS_FOR_GUARD = ["DateTimeOriginal", "DateTimeDigitized", "DateTime"]
EXIF_TAGS_FOR_SORTING = ["DateTimeOriginal", "DateTime", "DateTimeDigitized"]
NAME_PATTERNS = [
    r"(\d{4})[_\-](\d{2})[_\-](\d{2})[_\- T](\d{2})[_:\-](\d{2})[_:\-](\d{2})",
    r"(\d{4})(\d{2})(\d{2})[_\-]?(\d{2})(\d{2})(\d{2})",
    r"(\d{4})[_\-](\d{2})[_\-](\d{2})",
    r"(\d{4})(\d{2})(\d{2})",
]
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM",
            "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD"}


def exif_date(tags: Column, order: list[str] = EXIF_TAGS_FOR_GUARD) -> Column:
    """The first tag, in ``order``, that parses in any accepted form."""
    attempts = []
    for tag in order:
        text = F.trim(F.try_element_at(tags, F.lit(tag)))
        attempts += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in EXIF_FORMATS]
    return F.coalesce(*attempts)


def filename_date(name: Column) -> Column:
    """Patterns in order; only the first match of each is tried, and a bad date moves on to the next."""

    def made(d: Column) -> Column:
        """Digits, year first, as a timestamp; values out of range are told apart before anything is built."""
        part = lambda at, n, low, high: (F.substring(d, at, n).cast("int"), low, high)
        parts = [part(1, 4, 1990, 2040), part(5, 2, 1, 12), part(7, 2, 1, 31)]
        if_time = [part(9, 2, 0, 23), part(11, 2, 0, 59), part(13, 2, 0, 59)]
        sane = reduce(lambda a, b: a & b, [v.between(low, high) for v, low, high in parts])
        sane_time = reduce(lambda a, b: a & b, [v.between(low, high) for v, low, high in if_time])
        date, (h, m, s) = [v for v, _, _ in parts], [v for v, _, _ in if_time]
        zero = F.lit(0)
        return F.when(
            F.length(d) == 8, F.when(sane, F.try_make_timestamp(*date, zero, zero, zero.cast("double")))
        ).when(F.length(d) == 14, F.when(sane & sane_time, F.try_make_timestamp(*date, h, m, s.cast("double"))))

    def attempt(pattern: str) -> Column:
        digits = F.regexp_replace(F.regexp_extract(name, pattern, 0), "[^0-9]", "")
        return F.get(F.transform(F.array(digits), made), F.lit(0))  # bound once, used many times

    return F.coalesce(*[attempt(p) for p in NAME_PATTERNS]).cast("timestamp_ntz")


def resolved_date(exif: Column, name: Column, mtime: Column, use_exif=True, use_name=True, use_mtime=True) -> Column:
    sources = []
    if use_exif:
        sources.append(exif.cast("timestamp_ntz"))
    if use_name:
        sources.append(filename_date(name))
    if use_mtime:
        sources.append(mtime.cast("timestamp_ntz"))
    return F.coalesce(*sources) if sources else F.lit(None).cast("timestamp_ntz")


def strftime_pattern(fmt: str) -> str:
    """A ``strftime`` format as a Spark datetime pattern; other text is quoted."""
    out = []
    for field, text in re.findall(r"(%.)|([^%]+)", fmt):
        if field in STRFTIME:
            out.append(STRFTIME[field])
        elif field and field != "%%":
            raise ValueError(f"unsupported date format {field!r}")
        else:
            out.append("'" + (text or "%").replace("'", "''") + "'")
    return "".join(out)


def date_folder(date: Column, fmt: str = "%Y-%m-%d", unknown: str = "unknown_date") -> Column:
    return F.coalesce(F.date_format(date, strftime_pattern(fmt)), F.lit(unknown or "unknown_date"))
