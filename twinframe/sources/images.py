"""Perceptual features from pixels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.config import IMAGE_EXTENSIONS
from twinframe.functions.dates import exif_date
from twinframe.functions.labels import exif_field_count
from twinframe.functions.stats import histogram_entropy
from twinframe.sources.exif import read_exif_maps
from twinframe.session import materialise
from twinframe.sources.listing import list_files, plain_path

WORKING_SIZE = 1024
BATCH_PICTURES = 16  # decoded pictures are large
LUMA = np.array([0.299, 0.587, 0.114])
PIXEL_SCHEMA = (
    "path string, width int, height int, phashes array<bigint>, dhashes array<bigint>, brightness double, "
    "histogram array<double>"
)
# EXIF orientations that mirror the picture first, and the quarter turns that follow.
MIRRORED = (2, 4, 5, 7)
QUARTER_TURNS = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}


@lru_cache(maxsize=8)
def _lanczos(n_in: int, n_out: int) -> np.ndarray:
    """Row-normalised Lanczos-3 weights that resample ``n_in`` samples to ``n_out``."""
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    centre = (np.arange(n_out)[:, None] + 0.5) * scale
    x = (np.arange(n_in)[None, :] + 0.5 - centre) / stretch
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / 64)


def resize(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    out = np.tensordot(_lanczos(plane.shape[0], height), plane, axes=(1, 0))
    out = np.moveaxis(np.tensordot(_lanczos(plane.shape[1], width), out, axes=(1, 1)), 0, 1)
    return np.clip(np.round(out), 0, 255)


def _pack(bits: np.ndarray) -> int:
    """64 booleans, first one highest, as a signed long."""
    return int(np.packbits(bits.ravel()).view(">i8")[0])


def perceptual_hash(luma: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest frequencies against their median."""
    low = _cosines() @ resize(luma, 32, 32) @ _cosines().T
    return _pack(low > np.median(low))


def difference_hash(luma: np.ndarray) -> int:
    small = resize(luma, 9, 8)
    return _pack(small[:, 1:] > small[:, :-1])


def pixel_features(rgb: np.ndarray) -> dict:
    """Features of a picture as it is stored, with the hashes of all eight ways to turn it: place ``4 m + k`` is for
    mirrored (``m`` 1) or not, then ``k`` quarter turns. The orientation tag picks among them later, so pixels stay
    where they are decoded."""
    height, width = rgb.shape[:2]
    longest = max(height, width)
    if longest > WORKING_SIZE:
        share = WORKING_SIZE / longest
        rgb = resize(rgb, max(1, round(width * share)), max(1, round(height * share)))
    luma = np.round(rgb @ LUMA)
    counts = [np.bincount((rgb[..., c].astype(np.int64) >> 3).ravel(), minlength=32) for c in range(3)]
    ways = [np.rot90(plane, k) for plane in (luma, luma[:, ::-1]) for k in range(4)]
    return {
        "width": width, "height": height, "phashes": [perceptual_hash(w) for w in ways],
        "dhashes": [difference_hash(w) for w in ways], "brightness": float(luma.mean()),
        "histogram": np.concatenate([c / max(c.sum(), 1) for c in counts]).tolist(),
    }


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PIXEL_SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if r.width <= 0:
                rows.append({"path": r.path, "width": -1, "height": -1})
                continue
            pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
            # The image source stores blue first; one channel is grey.
            rgb = np.repeat(pixels, 3, axis=2) if r.channels == 1 else pixels[..., 2::-1]
            rows.append({"path": r.path, **pixel_features(rgb.astype(float))})
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype(object).where(out.notna(), None)


def _name_glob(extensions: list[str]) -> str:
    """A glob for names with one of the extensions in any case."""
    any_case = lambda ext: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "{" + ",".join(f"*{any_case(e)}" for e in extensions) + "}"


def decode(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Decoded pixels of the image files. A file that cannot be decoded has width -1."""
    reader = spark.read.format("image").option("pathGlobFilter", _name_glob(IMAGE_EXTENSIONS))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(root).select(
        plain_path(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def _decoded_features(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """One pass over the pictures, stored as small rows. Few pictures go to a Python worker at a time."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(BATCH_PICTURES))
    try:
        return materialise(decode(spark, root, recursive).mapInPandas(_features_of, PIXEL_SCHEMA), "pixels")
    finally:
        spark.conf.set(batch, before)


def image_features(spark: SparkSession, root: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(features, broken)`` of the image files below a root. Each file is decoded once and read once for EXIF."""
    files = list_files(spark, root, recursive).filter(F.col("ext").isin(IMAGE_EXTENSIONS))
    pixels = _decoded_features(spark, root, recursive)
    exif = materialise(read_exif_maps(spark, root, recursive, _name_glob(IMAGE_EXTENSIONS)), "exif")
    good = files.join(pixels.filter("width > 0"), "path").join(exif, "path", "left")
    orientation = F.coalesce(F.try_element_at("exif", F.lit("Orientation")).try_cast("int"), F.lit(1))
    turns = F.create_map(*[F.lit(x) for kv in QUARTER_TURNS.items() for x in kv])
    good = good.withColumn("m", F.when(orientation.isin(*MIRRORED), 4).otherwise(0)).withColumn(
        "k", F.coalesce(F.try_element_at(turns, orientation), F.lit(0)))
    way = lambda hashes, more: F.get(hashes, F.col("m") + (F.col("k") + more) % 4)
    sideways = F.col("k") % 2 == 1
    broken = files.join(pixels.filter("width > 0").select("path"), "path", "left_anti")
    return good.select(
        F.col("path").alias("image_id"), "dir", "name", "stem", "ext", "is_raw", F.lit(False).alias("is_video"),
        F.when(sideways, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(sideways, F.col("width")).otherwise(F.col("height")).alias("height"), "file_size", "mtime",
        way("phashes", 0).alias("phash"), *[way("phashes", k).alias(f"phash_r{90 * k}") for k in (1, 2, 3)],
        way("dhashes", 0).alias("dhash"),
        "brightness", "histogram", histogram_entropy(F.col("histogram")).alias("hist_entropy"),
        exif_field_count(F.col("exif")).alias("metadata_count"), exif_date(F.col("exif")).alias("exif_date"),
        F.array().cast("array<string>").alias("companions"), F.lit("").alias("hash_mode"),
    ), broken
