"""Hard negatives of anchors by a vertical scan of dimensions (BOND): whole and exact.

Vectors are stored as blocks of columns, one column per dimension, each block of one label. An anchor reads the columns
of a block in the descending order of its own magnitudes. After every few columns the score of each candidate is
known up to what the columns not read yet can add, which their minima and maxima bound; candidates that cannot count
any more leave the bitmap. For positives a candidate counts while it can be among the anchor's best of the
same label. For negatives it counts while its score can lie in the window of a positive and among the best there.
Both limits are carried on from block to block of a task. What is left at the last column has its exact score.

The anchors are a stated set of queries: parts of blocks meet groups of anchors in cells of bounded size, each cell is
one sorted run of a partition, and a cell hands on only the few best rows of each anchor. Labels that hold a third of
all rows are many blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.words import arrow_batches
from twinframe.session import materialise

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
EVERY = 100
SCALE = 256
BLOCK = 4096
PART_BLOCKS = 8
GROUP_ANCHORS = 2048
STRIDE = 8

BLOCK_SCHEMA = "block long, dims int, label long, ids array<long>, rows array<long>, anchors array<boolean>, columns binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with a label and a vector whose components are all finite."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def _blocks(embeddings: DataFrame, is_anchor: Column, label: Column) -> DataFrame:
    """Blocks of up to ``BLOCK`` rows of one label and length, rows in the order of ids (null last); columns hold 64-bit
    integers, dimension after dimension."""
    rows = usable(embeddings).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
        F.size("embedding").alias("dims"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
    parts = rows.repartitionByRange("dims", "label", F.xxhash64("row")).sortWithinPartitions("dims", "label", F.asc_nulls_last("id"), "row")

    def pack(batches):
        number = TaskContext.get().partitionId() << 40
        held, kind = [], None

        def close():
            nonlocal number, held
            b = pa.Table.from_batches(held).combine_chunks()
            dims, label = kind
            values = np.asarray(b.column("vector").combine_chunks().flatten(), np.float64).reshape(b.num_rows, dims)
            columns = np.ascontiguousarray(np.floor(SCALE * values).astype(np.int64).T)
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "dims": pa.array([dims], pa.int32()), "label": pa.array([label], pa.int64()),
                "ids": pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), "rows": pa.array([b.column("row").to_pylist()], pa.list_(pa.int64())),
                "anchors": pa.array([b.column("anchor").to_pylist()], pa.list_(pa.bool_())), "columns": pa.array([columns.tobytes()], pa.binary())})
            number, held = number + 1, []
            return out

        for b in batches:
            dims, labels = np.asarray(b.column("dims")), np.asarray(b.column("label"))
            turns = np.flatnonzero((np.diff(dims) != 0) | (np.diff(labels) != 0)) + 1
            for s, e in zip([0, *turns], [*turns, b.num_rows]) if b.num_rows else ():
                own = (int(dims[s]), int(labels[s]))
                while s < e:
                    room = BLOCK - sum(x.num_rows for x in held)
                    if held and (kind != own or room == 0):
                        yield close()
                        room = BLOCK
                    kind = own
                    held.append(b.slice(s, min(e - s, room)))
                    s += held[-1].num_rows
        if held:
            yield close()

    return parts.mapInArrow(pack, BLOCK_SCHEMA)


def _anchor_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of the anchors alone, under the numbers of the blocks they come from."""

    def pick(batches):
        for b in batches:
            for k in range(b.num_rows):
                taken = np.flatnonzero(np.asarray(b.column("anchors")[k].values, bool))
                if not len(taken):
                    continue
                dims = b.column("dims")[k].as_py()
                columns = np.frombuffer(b.column("columns")[k].as_buffer(), np.int64).reshape(dims, len(b.column("ids")[k]))[:, taken]
                at = pa.array(taken)
                yield pa.RecordBatch.from_arrays([
                    b.column("block").slice(k, 1), b.column("dims").slice(k, 1), b.column("label").slice(k, 1),
                    pa.array([b.column("ids")[k].values.take(at).to_pylist()], pa.list_(pa.int64())),
                    pa.array([b.column("rows")[k].values.take(at).to_pylist()], pa.list_(pa.int64())),
                    pa.array([[True] * len(taken)], pa.list_(pa.bool_())), pa.array([np.ascontiguousarray(columns).tobytes()], pa.binary()),
                ], names=b.schema.names)

    return blocks.mapInArrow(pick, BLOCK_SCHEMA)


class Columns:
    """One block as numbers: exact in doubles where all sums fit, else in 64-bit integers."""

    def __init__(self, dims: int, data: np.ndarray, ids: pa.Array, rows: np.ndarray):
        self.data, self.ids, self.rows = data.reshape(dims, len(rows)), ids, rows
        self.low, self.high = self.data.min(axis=1), self.data.max(axis=1)
        self.peak = int(max(-self.low.min(), self.high.max(), 0)) if dims else 0
        self.doubles = self.data.astype(np.float64) if dims * self.peak < 1 << 52 else None

    def scan(self, vector: np.ndarray, kept) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ``kept(lower, upper)`` never drops, and their scores; the columns are read in the descending
        order of the vector's magnitudes."""
        order = np.argsort(-np.abs(vector), kind="stable")
        a, b = vector * self.low, vector * self.high
        least, most = np.minimum(a, b)[order], np.maximum(a, b)[order]
        left_low = np.concatenate((np.cumsum(least[::-1])[::-1], [0]))
        left_high = np.concatenate((np.cumsum(most[::-1])[::-1], [0]))
        peak = int(np.abs(vector).max()) if len(vector) else 0
        data = self.doubles if self.doubles is not None and len(vector) * self.peak * peak < 1 << 52 else self.data
        weights = vector.astype(data.dtype)
        alive = np.arange(self.data.shape[1])
        scores = np.zeros(len(alive), data.dtype)
        for start in range(0, len(order), STRIDE):
            read = order[start:start + STRIDE]
            if len(alive) == self.data.shape[1]:
                scores = scores + weights[read] @ data[read]
            else:
                scores = scores + weights[read] @ data[read[:, None], alive]
            end = min(start + STRIDE, len(order))
            stay = kept(scores + left_low[end], scores + left_high[end])
            if not stay.all():
                alive, scores = alive[stay], scores[stay]
            if not len(alive):
                break
        return alive, scores.astype(np.int64)


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


class Best:
    """The best ``k`` rows so far with scores from ``low`` to ``high``: higher scores first, ties by smaller id, null last."""

    def __init__(self, k: int, low=-(1 << 63), high=(1 << 63) - 1):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def limit(self):
        """What a further row has to reach."""
        return max(self.low, self.rows[-1][-1]) if len(self.rows) == self.k else self.low

    def reachable(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Which candidates can still be among the best."""
        limit = self.limit()
        if len(lower) >= self.k:
            sure = lower[(lower >= self.low) & (upper <= self.high)]
            if len(sure) >= self.k:
                limit = max(limit, _kth(sure, self.k))
        return (upper >= limit) & (lower <= self.high)

    def add(self, block: Columns, alive: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.limit()) & (scores <= self.high)
        alive, scores = alive[fits], scores[fits]
        if not len(alive):
            return
        if len(alive) > self.k:
            best = np.lexsort((alive, -scores))[:self.k]
            alive, scores = alive[best], scores[best]
        ids = block.ids.take(pa.array(alive)).to_pylist()
        new = [(-s, i is None, i or 0, row, i, s) for s, i, row in zip(scores.tolist(), ids, block.rows[alive].tolist())]
        self.rows = sorted(self.rows + new)[:self.k]


def _cells(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor blocks and blocks dealt into cells ``(p, g)``, the anchors of a cell before its blocks."""
    spark = blocks.sparkSession
    n_blocks = blocks.count()
    n_anchors = anchors.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    parts, groups = -(-n_blocks // PART_BLOCKS) or 1, -(-n_anchors // GROUP_ANCHORS) or 1
    # Copies of a block: one per group of anchors; copies of an anchor: one per part of the blocks.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    data = blocks.drop("anchors").withColumn("windows", F.lit(None).cast(anchors.schema["windows"].dataType)).withColumn(
        "p", deal(parts)).withColumn("g", every(groups)).withColumn("kind", F.lit(1))
    asking = anchors.drop("anchors").withColumn("g", deal(groups)).withColumn("p", every(parts)).withColumn("kind", F.lit(0))
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = asking.unionByName(data).repartition(max(at_least, min(2 * parts * groups, 100_000)), "p", "g")
    return both.sortWithinPartitions("p", "g", "kind", "block")


WINDOWS = "array<struct<row:long,tag:int,low:long,high:long>>"
MET_SCHEMA = "anchor_block long, anchor_row long, anchor_id long, tag int, score long, other_id long, other_row long"


def _met(cells: DataFrame, same_label: bool, targets) -> DataFrame:
    """Each anchor of a cell scans the cell's blocks of its own label, or of all others. ``targets(windows)`` gives
    the anchor's ``(tag, Best)`` list; the rows found go out when the cell ends."""

    def run(batches):
        cell, asking = None, []

        def close():
            found = [(block, row, i, tag, s, got, other) for block, row, i, _, _, _, bests in asking for tag, best in bests
                     for *_, other, got, s in best.rows]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_block", "anchor_row", "anchor_id", "tag", "score", "other_id", "other_row"]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            for k in range(b.num_rows):
                own = (b.column("p")[k].as_py(), b.column("g")[k].as_py())
                if own != cell:
                    if asking:
                        yield close()
                    cell, asking = own, []
                dims, label = b.column("dims")[k].as_py(), b.column("label")[k].as_py()
                data = np.frombuffer(b.column("columns")[k].as_buffer(), np.int64)
                ids, rows = b.column("ids")[k].values, np.asarray(b.column("rows")[k].values)
                if b.column("kind")[k].as_py() == 0:
                    windows = b.column("windows")[k].as_py() or []
                    of_row = targets(rows.tolist(), windows)
                    block = b.column("block")[k].as_py()
                    vectors = data.reshape(dims, len(rows))
                    for j, (row, i) in enumerate(zip(rows.tolist(), ids.to_pylist())):
                        if of_row[row]:
                            asking.append((block, row, i, dims, label, vectors[:, j].copy(), of_row[row]))
                    continue
                chosen = [x for x in asking if x[3] == dims and (x[4] == label) == same_label]
                if not chosen:
                    continue
                columns = Columns(dims, data, ids, rows)
                for *_, vector, bests in chosen:

                    def kept(lower, upper, bests=bests):
                        stay = bests[0][1].reachable(lower, upper)
                        for _, best in bests[1:]:
                            if stay.all():
                                break
                            stay = stay | best.reachable(lower, upper)
                        return stay

                    alive, scores = columns.scan(vector, kept)
                    for _, best in bests:
                        best.add(columns, alive, scores)
        if asking:
            yield close()

    return cells.mapInArrow(run, MET_SCHEMA)


def _ranked(met: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, is_anchor: Column | None = None, label: Column | None = None,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``embeddings (vec_id, embedding, label)``.

    Components become ``floor(256 * x)``, a score is the inner product of two rows, higher scores come first and equal
    ones go by the smaller ``vec_id``, null last. An anchor's positives are its best ``positives`` other rows of the
    same label; for each of them the best ``negatives`` rows of other labels follow whose score is from ``low`` to
    ``high`` per cent of the positive's (both limits included; none where the positive's score is negative).
    ``is_anchor`` (``vec_id`` divisible by 100) and ``label`` may be given as columns of the table.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A null ``vec_id`` is a row
    like any other, but no anchor. Rows that repeat an id are rows of their own, as anchors too. Vectors of different
    lengths never meet. Scores must fit in 64 bits. An empty table gives no rows; other columns are not read.
    """
    is_anchor = F.col("vec_id") % EVERY == 0 if is_anchor is None else is_anchor
    label = F.col("label") if label is None else label
    spark = embeddings.sparkSession
    with arrow_batches(spark, BLOCK):
        blocks = materialise(_blocks(embeddings, is_anchor, label), "blocks")
    with arrow_batches(spark, 4):
        anchors = materialise(_anchor_blocks(blocks), "anchors")
        asking = anchors.withColumn("windows", F.lit(None).cast(WINDOWS))
        # One more than asked for, as the anchor itself is among them.
        first = _met(_cells(blocks, asking), True, lambda rows, _: {r: [(0, Best(positives + 1))] for r in rows})
        near = materialise(_ranked(first.filter("anchor_row <> other_row"), ["anchor_row"], positives).select(
            "anchor_block", "anchor_row", "anchor_id", F.col("rank").alias("tag"), F.col("other_id").alias("positive_id"),
            F.col("score").alias("positive_score")), "positives")
        floor = lambda share: F.expr(f"({share} * positive_score - pmod({share} * positive_score, 100)) div 100")
        least, most = -floor(-low), floor(high)
        windows = near.select("anchor_block", F.struct(
            F.col("anchor_row").alias("row"), "tag", least.alias("low"), most.alias("high")).alias("w")).filter("w.low <= w.high")
        # A block has few rows and each a few windows, so the list is bounded.
        of_block = windows.groupBy("anchor_block").agg(F.collect_list("w").cast(WINDOWS).alias("windows"))
        asking = materialise(anchors.join(of_block, anchors["block"] == of_block["anchor_block"]).drop("anchor_block"), "asking")

        def targets(rows, windows):
            out = {r: [] for r in rows}
            for w in windows:
                out[w["row"]].append((w["tag"], Best(negatives, w["low"], w["high"])))
            return out

        far = materialise(_met(_cells(blocks, asking), False, targets), "negatives")
    ranked = _ranked(far, ["anchor_row", "tag"], negatives).withColumnRenamed("other_id", "negative_id").withColumnRenamed(
        "score", "negative_score").drop("anchor_block", "anchor_id", "other_row")
    return near.drop("anchor_block").join(ranked, ["anchor_row", "tag"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
