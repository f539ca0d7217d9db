"""Columns over 64-bit perceptual hashes, held as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROTATIONS = ["phash_r90", "phash_r180", "phash_r270"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_long(h: Column) -> Column:
    """16 hex characters to a signed long; anything else (the empty string of a missing hash) to null."""
    half = lambda start: F.conv(F.substring(h, start, 8), 16, 10).cast("long")
    return F.when(F.length(h) == 16, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def long_to_hex(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v), 16, "0"))


def rotation_distance(a: Column, b: Column, both_ways: bool = True) -> Column:
    """Smallest distance over the orientations; ``least`` skips a missing rotation."""
    options = [hamming(a["phash"], b["phash"])]
    options += [hamming(a["phash"], b[r]) for r in ROTATIONS]
    if both_ways:
        options += [hamming(a[r], b["phash"]) for r in ROTATIONS]
    return F.least(*options)
