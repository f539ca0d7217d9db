"""Removal of word windows that occur more than once, found through difference-cover anchors.

A difference cover ``D`` of period ``v`` has, for any two positions ``i`` and ``j``, an offset ``d < v`` with both
``(i + d) mod v`` and ``(j + d) mod v`` in ``D``. Short windows (anchors) are therefore hashed only where the position
modulo ``v`` lies in ``D``: two equal windows of ``length`` words share at least one anchor of ``length - v + 1`` words
at the same place inside both. Windows around anchors that occur once are unique; only windows around repeated
anchors are extended to their full length, hashed and compared.

The texts are dealt into buckets of about ``BUCKET_BYTES``. A bucket asks each hash bin once about each of its distinct
hashes, so a passage that fills a third of all rows is one entry per bucket, and a bin answers with the hashes that
occur elsewhere. The text itself is shuffled once and that exchange is read three times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.words import as_text, mixed, owners, split_words, window_hashes, word_hashes

LENGTH = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # all differences modulo 21
BUCKET_BYTES = 8 << 20
SECOND = np.uint64(0xD6E8FEB86659FD93)
ENTRY = np.dtype([("first", "<u8"), ("second", "<u4")])
ASKED = "bin long, bucket long, once binary, more binary"
ANSWER = "bucket long, known binary"


def is_cover(cover, period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _buckets(documents: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a bucket by id and text. The number of buckets follows the bytes of the table."""
    rows = documents.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at_least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-size // BUCKET_BYTES), at_least)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), n


def _asked(entries: np.ndarray, keys: np.ndarray, counts: np.ndarray, bins: int, bucket) -> pa.Table:
    """Distinct entries of a bucket by bin: those met once here, and those met more often."""
    to = (keys % np.uint64(bins)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to, entries, several = to[order], entries[order], counts[order] > 1
    cuts = np.flatnonzero(np.diff(to)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(to)]))
    out: dict[str, list] = {"bin": [], "once": [], "more": []}
    for s, e in zip(starts, ends) if len(to) else ():
        part, multi = entries[s:e], several[s:e]
        out["bin"].append(int(to[s]))
        out["once"].append(part[~multi].tobytes())
        out["more"].append(part[multi].tobytes())
    return pa.table({
        "bin": pa.array(out["bin"], pa.int64()), "bucket": pa.array([bucket] * len(out["bin"]), pa.int64()),
        "once": pa.array(out["once"], pa.binary()), "more": pa.array(out["more"], pa.binary()),
    })


def _answers(dtype: np.dtype):
    """For each bucket the hashes of this bin that occur at two places or more."""

    def answer(table: pa.Table) -> pa.Table:
        once = [np.frombuffer(b, dtype) for b in table["once"].to_pylist()]
        more = [np.frombuffer(b, dtype) for b in table["more"].to_pylist()]
        origin = np.repeat(np.arange(len(once)), [len(a) + len(b) for a, b in zip(once, more)])
        entries = np.concatenate([x for pair in zip(once, more) for x in pair])
        multi = np.concatenate([np.full(len(x), k, bool) for pair in zip(once, more) for k, x in enumerate(pair)])
        first = entries["first"] if dtype.names else entries
        order = np.lexsort((entries["second"], first)) if dtype.names else np.argsort(first, kind="stable")
        ordered = entries[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=multi[order]) > 0)
        hit = repeated[group]
        origin, hashes = origin[order][hit], first[order][hit]
        by = np.argsort(origin, kind="stable")
        origin, hashes = origin[by], hashes[by]
        buckets = table["bucket"].to_pylist()
        found = np.unique(origin)
        ends = np.searchsorted(origin, found, side="right")
        starts = np.searchsorted(origin, found, side="left")
        return pa.table({
            "bucket": pa.array([buckets[o] for o in found], pa.int64()),
            "known": pa.array([hashes[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
        })

    return answer


def _known(table: pa.Table) -> np.ndarray:
    blobs = table["known"].to_pylist()
    return np.sort(np.frombuffer(b"".join(blobs), np.uint64))


def _is_known(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _read(table: pa.Table, length: int):
    """Words of a bucket, the text of each word, and which words start a whole window of their text."""
    offsets, words = split_words(as_text(table["text"]))
    hashes = word_hashes(words)
    owner = owners(offsets)
    left = offsets[1:][owner] - np.arange(len(hashes))  # words from here to the end of the text
    return offsets, words, hashes, owner, left


def remove_repeated_windows(documents: DataFrame, length: int = LENGTH, period: int = PERIOD,
                            cover: tuple[int, ...] = COVER) -> DataFrame:
    """``doc_id, text, n_words, n_removed, kept_text`` for every row of ``documents (doc_id, text)``.

    Each word covered by a window of ``length`` words whose sequence also starts elsewhere (same text included) is
    removed; the kept words are joined by one space. All windows are judged on the input. Null and empty texts, and
    texts shorter than a window, keep everything (a null text gives the empty text). Repeated rows count as places of
    their own, so a repeated row of ``length`` words or more is removed whole. Columns other than ``doc_id`` and
    ``text`` are not read. An empty table gives no rows.
    """
    return _removed(documents, length, period, cover, digest=False)


def removal_digests(documents: DataFrame, length: int = LENGTH, period: int = PERIOD,
                    cover: tuple[int, ...] = COVER) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: as ``remove_repeated_windows``, with a digest of the kept text."""
    return _removed(documents, length, period, cover, digest=True)


def _removed(documents, length, period, cover, digest):
    anchor = length - period + 1
    if not is_cover(cover, period) or anchor < 1:
        raise ValueError("the cover must have every difference and leave room for an anchor")
    covered = np.zeros(period, bool)
    covered[list(cover)] = True
    rows, bins = _buckets(documents)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def ask_anchors(table):
        offsets, _, hashes, owner, left = _read(table, length)
        whole = offsets[1:] - offsets[:-1] >= length
        inside = np.arange(len(hashes)) - offsets[:-1][owner]
        places = np.flatnonzero(covered[inside % period] & (left >= anchor) & whole[owner])
        values = mixed(window_hashes(hashes, anchor)[places]) if len(places) else np.zeros(0, np.uint64)
        values, counts = np.unique(values, return_counts=True)
        return _asked(values, values, counts, bins, table["bucket"][0].as_py())

    def ask_windows(key, table, answers):
        known = _known(answers)
        if not table.num_rows or not len(known):
            return _asked(np.zeros(0, ENTRY), np.zeros(0, np.uint64), np.zeros(0), bins, 0)
        offsets, _, hashes, owner, left = _read(table, length)
        inside = np.arange(len(hashes)) - offsets[:-1][owner]
        places = np.flatnonzero(covered[inside % period] & (left >= anchor))
        places = places[_is_known(mixed(window_hashes(hashes, anchor)[places]), known)]
        # An anchor lies in the windows that start up to period - 1 words before it, in the same text.
        steps = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(steps, np.maximum(places - period + 1, offsets[:-1][owner[places]]), 1)
        np.add.at(steps, places + 1, -1)
        starts = np.flatnonzero((np.cumsum(steps)[:-1] > 0) & (left >= length))
        entries = np.empty(len(starts), ENTRY)
        if len(starts):
            entries["first"] = mixed(window_hashes(hashes, length)[starts])
            entries["second"] = (mixed(window_hashes(hashes, length, SECOND)[starts]) >> np.uint64(32)).astype("<u4")
        order = np.lexsort((entries["second"], entries["first"]))
        entries = entries[order]
        new = np.flatnonzero(np.concatenate(([True], entries[1:] != entries[:-1]))) if len(entries) else order
        counts = np.diff(np.concatenate((new, [len(entries)])))
        entries = entries[new]
        return _asked(entries, entries["first"], counts, bins, key[0].as_py())

    def remove(key, table, answers):
        known = _known(answers)
        offsets, words, hashes, _, left = _read(table, length)
        gone = np.zeros(len(hashes), bool)
        if len(known) and len(hashes) >= length:
            values = mixed(window_hashes(hashes, length))
            starts = np.flatnonzero(_is_known(values, known) & (left[: len(values)] >= length))
            steps = np.zeros(len(hashes) + 1, np.int64)
            steps[starts] += 1
            np.add.at(steps, starts + length, -1)
            gone = np.cumsum(steps)[:-1] > 0
        n_words = np.diff(offsets)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[offsets])
        kept = []
        texts = table["text"].to_pylist()
        for k, text in enumerate(texts):
            s, e = offsets[k], offsets[k + 1]
            parts = (text or "").encode().split()
            if removed[k]:
                parts = [parts[i] for i in np.flatnonzero(~gone[s:e])]
            joined = b" ".join(parts)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        out = {"doc_id": table["doc_id"]}
        if not digest:
            out["text"] = table["text"]
        out |= {"n_words": pa.array(n_words), "n_removed": pa.array(removed)}
        out["kept_sha256" if digest else "kept_text"] = pa.array(kept, pa.string())
        return pa.table(out)

    asked = rows.groupBy("bucket").applyInArrow(ask_anchors, ASKED)
    shared = asked.groupBy("bin").applyInArrow(_answers(np.dtype("<u8")), ANSWER)
    asked = rows.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(ask_windows, ASKED)
    repeated = asked.groupBy("bin").applyInArrow(_answers(ENTRY), ANSWER)
    schema = f"doc_id {id_type}, " + ("" if digest else "text string, ") + "n_words long, n_removed long, " + (
        "kept_sha256 string" if digest else "kept_text string")
    return rows.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(remove, schema)
