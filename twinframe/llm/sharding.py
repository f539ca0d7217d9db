"""Contiguous shards of near-equal bytes over ordered atomic groups: a minimax partition.

Rows are ordered by the digest of their text, so equal texts are neighbours and form one group that is never cut. The
smallest capacity is searched for which greedy filling (each shard takes whole groups while they fit) needs no more
than the given number of shards; then the cuts are placed.

The prefix sums of the groups stay distributed. The driver holds a bounded list of known group ends (``2 * KNOWN`` per
round) and follows the greedy walk as an interval: where the walk ends up in a gap whose groups it does not know, the
cut lies between the gap's ends. Binary search over the capacity on both interval ends leaves a narrow range, the gaps
that its cuts touch are looked up more finely in one aggregate, and so on: each round divides the open gaps by
thousands, so two or three rounds settle a table of any size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.session import materialise

KNOWN = 1 << 14
OVERHEAD = 16


def _ordered(documents: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows in order with running sums inside their part, and what lies before each part (one entry per part)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text, 256))).alias("digest"),
    )
    order = ["digest", F.col("doc_id").asc_nulls_first()]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        total = count = 0
        for b in batches:
            sums = np.cumsum(np.asarray(b.column("size"))) + total
            numbers = np.arange(1, b.num_rows + 1) + count
            if b.num_rows:
                total, count = int(sums[-1]), int(numbers[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sums, pa.int64()), pa.array(numbers, pa.int64())], names=[*b.schema.names, "upto", "number"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, size long, text_crc32 long, digest binary, part int, upto long, number long"
    written = materialise(parts.mapInArrow(run, schema), "ordered")
    before, bytes_, rows_ = {}, 0, 0
    for r in sorted(written.groupBy("part").agg(F.max("upto").alias("b"), F.max("number").alias("n")).collect()):
        before[r.part] = (bytes_, rows_)
        bytes_, rows_ = bytes_ + r.b, rows_ + r.n
    return written, before


class Prefixes:
    """Group ends as far as they are known: ends in bytes, the rows up to each, and which gaps below are settled.

    ``largest`` is the size of the largest group where it is known: no capacity is below it.
    """

    def __init__(self, ends: DataFrame | None, total: int, largest: int = 0):
        self.ends, self.total, self.largest, self.looks = ends, total, largest, 0
        self.values, self.rows, self.settled = [0], [0], [True]
        self.look([(0, total)])

    def look(self, gaps: list[tuple[int, int]]) -> None:
        """Learns up to ``2 * KNOWN`` ends inside the gaps ``(low, high]``, by one aggregate over the group ends.

        Each gap is cut into slots; the smallest and the largest end of a slot are learned, so a gap whose ends all
        lie in one slot gets narrower too, and a slot of up to two ends is settled.
        """
        self.looks += 1
        each = max(2, KNOWN // len(gaps))
        limits, inside = [], []  # ``inside[k]``: (limits[k - 1], limits[k]] is part of a gap
        for low, high in sorted(gaps):
            if not limits or limits[-1] != low:
                limits.append(low)
                inside.append(False)
            steps = sorted({low + (high - low) * k // each for k in range(1, each + 1)} - {low})
            limits += steps
            inside += [True] * len(steps)
        known = dict(zip(self.values, zip(self.rows, self.settled)))
        for n, first, first_rows, last, last_rows in self.slots(np.array(limits, np.int64), np.array([*inside, False])):
            known[first] = (first_rows, True)
            known[last] = (last_rows, n <= 2)
        self.values = sorted(known)
        self.rows = [known[v][0] for v in self.values]
        self.settled = [known[v][1] for v in self.values]

    def slots(self, bounds: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Per wanted slot with ends: their number, and the smallest and largest with the rows up to each."""

        def slot(batches):
            for b in batches:
                at = np.searchsorted(bounds, np.asarray(b.column("end")), side="left")  # bounds[at - 1] < end <= bounds[at]
                take = pa.array(np.flatnonzero(wanted[at]), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(at, pa.int64()).take(take), "end": b.column("end").take(take), "upto_rows": b.column("upto_rows").take(take)})

        found = self.ends.mapInArrow(slot, "slot long, end long, upto_rows long").groupBy("slot").agg(
            F.count(F.lit(1)), F.min("end"), F.min("upto_rows"), F.max("end"), F.max("upto_rows"))
        return [tuple(r)[1:] for r in found.collect()]

    def below(self, x: int) -> tuple[int, int]:
        """Between which values the largest group end of at most ``x`` lies."""
        if x >= self.total:
            return self.total, self.total
        k = bisect_right(self.values, x) - 1
        return self.values[k], self.values[k] if self.settled[k + 1] else x

    def above(self, x: int) -> tuple[int, int]:
        """Between which values the smallest group end of at least ``x`` lies."""
        if x <= 0:
            return 0, 0
        k = bisect_left(self.values, x)
        return (self.values[k] if self.settled[k] or self.values[k] == x else x), self.values[k]

    def open_gaps(self, spans) -> list[tuple[int, int]]:
        """The unsettled gaps that any span ``(low, high)`` touches."""
        out = set()
        for low, high in spans:
            k = max(1, bisect_right(self.values, low))
            while k < len(self.values) and self.values[k - 1] <= high:
                if not self.settled[k]:
                    out.add((self.values[k - 1], self.values[k]))
                k += 1
        return sorted(out)


def greedy(prefixes: Prefixes, capacity: int, shards: int, forward: bool = True) -> list[tuple[int, int]]:
    """Where each cut of the greedy walk lies, as an interval; backward the walk starts at the end."""
    low = high = 0 if forward else prefixes.total
    cuts = [(low, high)]
    for _ in range(shards):
        if forward:
            low, high = prefixes.below(low + capacity)[0], prefixes.below(high + capacity)[1]
        else:
            low, high = prefixes.above(low - capacity)[0], prefixes.above(high - capacity)[1]
        cuts.append((low, high))
    return cuts


def _smallest(test, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if test(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(prefixes: Prefixes, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and cuts that keep to it with each cut as near as possible to its equal share."""
    total = prefixes.total
    while True:
        # Surely too small below ``low``, surely enough from ``high`` on.
        low = _smallest(lambda c: greedy(prefixes, c, shards)[-1][1] >= total, max(-(-total // shards), prefixes.largest), total)
        high = _smallest(lambda c: greedy(prefixes, c, shards)[-1][0] >= total, low, total)
        if low == high:
            break
        # Only cuts that a walk leaves open: what lies between the cuts of two walks need not be known.
        walks = [greedy(prefixes, c, shards) for c in {low, (low + high) // 2, high - 1}]
        gaps = prefixes.open_gaps([cut for walk in walks for cut in walk[1:-1] if cut[0] < cut[1]])
        if not gaps:  # the open cut is the last one
            gaps = prefixes.open_gaps([walk[-1] for walk in walks])
        prefixes.look(gaps)
    capacity = high
    while True:
        ahead, back = greedy(prefixes, capacity, shards), greedy(prefixes, capacity, shards, forward=False)[::-1]
        shares = [total * k // shards for k in range(shards + 1)]
        gaps = prefixes.open_gaps([c for c in back[1:-1]] + [c for c in ahead[1:-1]] + [(x, x) for x in shares[1:-1]])
        if not gaps:
            break
        prefixes.look(gaps)
    cuts = [0]
    for k in range(1, shards):
        least, most = back[k][0], prefixes.below(cuts[-1] + capacity)[0]
        under, over = prefixes.below(shares[k])[0], prefixes.above(shares[k])[1]
        near = under if shares[k] - under <= over - shares[k] else over
        cuts.append(min(max(near, least, cuts[-1]), most))
    return capacity, [*cuts, total]


def byte_shards(documents: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``documents (doc_id, text)``.

    A row's size is its text's bytes in UTF-8 plus 16; a null text has none, and nulls are one group apart from the
    empty text. Equal texts share a shard however many there are, so a group larger than a fair share makes its shard
    as large as itself. ``slot`` counts the rows of a shard from 0 without gaps, in the order of digest and ``doc_id``;
    rows that repeat in both are interchangeable. With fewer groups than shards some shards stay empty. An empty table
    gives no rows. Other columns are not read.
    """
    ordered, before = _ordered(documents)
    spark = documents.sparkSession
    offsets = spark.createDataFrame(
        [(p, b, n) for p, (b, n) in before.items()] or [(0, 0, 0)], "part int, bytes_before long, rows_before long")
    # One row per part of the range partitioning, so the size of this side is known and small.
    rows = ordered.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", "digest", (F.col("upto") + F.col("bytes_before")).alias("end"),
        (F.col("number") + F.col("rows_before")).alias("upto_rows"))
    ends = materialise(rows.groupBy("digest").agg(
        F.max("end").alias("end"), F.max("upto_rows").alias("upto_rows"), F.sum("size").alias("bytes")).drop("digest"), "ends")
    total, largest = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    prefixes = Prefixes(ends.drop("bytes"), total, largest)
    _, cuts = minimax_cuts(prefixes, shards)
    rows_at = dict(zip(prefixes.values, prefixes.rows))
    inner = F.array(*[F.lit(c).cast("long") for c in cuts[1:-1]])
    starts = F.array(*[F.lit(rows_at[c]).cast("long") for c in cuts[:-1]])
    shard = F.size(F.filter(inner, lambda c: c < F.col("end")))
    return rows.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("upto_rows") - 1 - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
