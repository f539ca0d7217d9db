"""Words of Arrow text columns as 64-bit hashes, and hashes of word sequences, without a Python loop over words."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

STEP = np.uint64(0x9E3779B97F4A7C15)


def as_text(column) -> pa.Array:
    """One contiguous Arrow string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column, "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``offsets`` (one more than texts) into the flat array of all words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if filled.all():
        return offsets, flat
    before = np.concatenate(([0], np.cumsum(filled)))
    return before[offsets], flat.filter(pa.array(filled))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word; each distinct word of the array is hashed once."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    return hashes[np.asarray(coded.indices)]


def window_hashes(hashes: np.ndarray, length: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of the ``length`` items from each position on; positions without a whole window are left out.

    The hash of a window is a polynomial in ``step``, so two windows side by side combine with one multiplication:
    the length is built up from its binary digits.
    """
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        whole, covered = None, 0
        power, factor, block = 1, step, hashes
        while True:
            if length & power:
                if whole is None:
                    whole = block
                else:
                    size = len(hashes) - covered - power + 1
                    whole = whole[:size] * factor + block[covered:covered + size]
                covered += power
            if power * 2 > length:
                return whole[: len(hashes) - length + 1]
            size = len(block) - power
            block = block[:size] * factor + block[power:power + size]
            factor = factor * factor
            power *= 2


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Slices of a batch with about ``limit`` bytes of text each; one longer text is a slice of its own."""
    texts = as_text(batch.column(column))
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """For jobs that run inside: at most so many rows go to a Python worker at a time, which bounds its memory and the
    buffers beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
