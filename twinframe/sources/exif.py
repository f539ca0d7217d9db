"""EXIF blocks as ``map<string,string>``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.sources.listing import plain_path

# Names of the tags cameras write. Other tags are shown by number.
TAG_NAMES = {
    256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 270: "ImageDescription",
    271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit",
    305: "Software", 306: "DateTime", 315: "Artist", 531: "YCbCrPositioning", 33432: "Copyright",
    33434: "ExposureTime", 33437: "FNumber", 34850: "ExposureProgram", 34853: "GPSInfo", 34855: "ISOSpeedRatings",
    36864: "ExifVersion", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37377: "ShutterSpeedValue",
    37378: "ApertureValue", 37379: "BrightnessValue", 37380: "ExposureBiasValue", 37381: "MaxApertureValue",
    37382: "SubjectDistance", 37383: "MeteringMode", 37384: "LightSource", 37385: "Flash", 37386: "FocalLength",
    37500: "MakerNote", 37510: "UserComment", 40961: "ColorSpace", 40962: "ExifImageWidth", 40963: "ExifImageHeight",
    41486: "FocalPlaneXResolution", 41487: "FocalPlaneYResolution", 41495: "SensingMethod", 41985: "CustomRendered",
    41986: "ExposureMode", 41987: "WhiteBalance", 41988: "DigitalZoomRatio", 41989: "FocalLengthIn35mmFilm",
    41990: "SceneCaptureType", 42034: "LensSpecification", 42035: "LensMake", 42036: "LensModel",
    50341: "PrintImageMatching",
}
EXIF_IFD, GPS_IFD = 34665, 34853
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure that holds the tags: a JPEG APP1 segment, a PNG chunk, or the file itself."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack(">H", data[at + 2:at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4:at + 10] == b"Exif\0\0":
                return data[at + 10:at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at:at + 8])
            if kind == b"eXIf":
                return data[at + 8:at + 8 + size]
            at += 12 + size
    elif data[:4] in (b"II*\0", b"MM\0*"):
        return data
    return None


def _value(block: bytes, order: str, kind: int, count: int, raw: bytes):
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind == 7:
        return raw.decode("utf-8", "replace")
    if kind in (5, 10):
        parts = struct.unpack(order + ("I" if kind == 5 else "i") * (2 * count), raw)
        values = [n / d if d else float("nan") for n, d in zip(parts[::2], parts[1::2])]
    else:
        values = list(struct.unpack(order + FIELD_CODE[kind] * count, raw))
    return values[0] if count == 1 else values


def parse_exif(data: bytes) -> dict[str, str]:
    """Tag names to values as text. Anything malformed ends the reading, never the job."""
    found: dict[str, str] = {}
    block = _tiff_block(data)
    if not block:
        return found
    try:
        order = "<" if block[:2] == b"II" else ">"
        todo = [struct.unpack(order + "I", block[4:8])[0]]
        seen = set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for i in range(struct.unpack(order + "H", block[at:at + 2])[0]):
                entry = block[at + 2 + 12 * i:at + 14 + 12 * i]
                tag, kind, count = struct.unpack(order + "HHI", entry[:8])
                size = FIELD_SIZE.get(kind, 0) * count
                start = struct.unpack(order + "I", entry[8:])[0]
                raw = entry[8:8 + size] if size <= 4 else block[start:start + size]
                if tag == EXIF_IFD:
                    todo.append(start)
                elif size and len(raw) == size:
                    found[TAG_NAMES.get(tag, str(tag))] = str(_value(block, order, kind, count, raw))
    except (struct.error, KeyError):
        pass
    return found


def _maps_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "exif": [parse_exif(bytes(c)) for c in pdf["content"]]})


def read_exif_maps(spark: SparkSession, root: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """``(path, exif)`` for the files below a root, those that match ``glob`` if one is given; files without a block
    have an empty map."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(root).select(plain_path(F.col("path")).alias("path"), "content")
    return files.mapInPandas(_maps_of, "path string, exif map<string,string>")
