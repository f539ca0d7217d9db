"""Near nodes by comparing blocks of them, for radii that leave no selective key.

Nodes are dealt into blocks of bounded size by a hash, each block is packed into one row of columns, and every pair of
blocks is one row of a join: Spark deals those rows over the tasks, and a task compares two blocks with a few array
operations, so memory is that of two blocks. All pairs are compared, but what is handed on stays small:

1. every node first meets its nearest ones in a few blocks only, which settles most of what is connected;
2. then all blocks meet. A pair is handed on only where some configuration that could still link nodes this far apart has
   them in different components, so dense places list nothing.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.functions.hashing import ROTATIONS
from twinframe.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCKS = 16  # blocks of a small table; a large one has more
LEAST_BLOCK = 4096
LARGEST_BLOCK = 32768
NEAREST = 2  # nearest nodes of a node in a block
NEAREST_BLOCKS = 3
CHUNK = 1 << 20  # distances held at once
NONE = 127
FIXED = ["node_id", "scope_", "bin", "raw", "phash", *ROTATIONS, "missing", "dhash"]


class Reach:
    """Which configurations can link two nodes at a distance, in steps of their radius.

    ``step[d]`` is the first step that reaches the distance ``d`` (``NONE``: no configuration does). The configurations of
    a step are those with at least its radius; ``columns[k]`` is the place of their joint component among the columns.
    """

    def __init__(self, radii: dict[int, int], joint: dict[tuple[int, ...], int], second: dict[int, int] | None = None):
        self.radii = sorted(set(radii.values()))
        self.step = np.full(256, NONE, np.int8)
        self.second = np.full(256, NONE, np.int8)
        self.columns = []
        for k, r in reversed(list(enumerate(self.radii))):
            self.step[:min(r, 64) + 1] = k
            if second is not None:
                self.second[:max(second[c] for c in radii if radii[c] == r) + 1] = k
        for r in self.radii:
            own = tuple(c for c in sorted(radii) if radii[c] >= r)
            self.columns.append(joint.setdefault(own, len(joint)))
        self.columns = np.array(self.columns, np.int64)
        self.widest = self.radii[-1] if self.radii else -1
        self.widest_second = int(np.flatnonzero(self.second != NONE)[-1]) if second is not None and radii else 64


class Reaches:
    """The four ways in which nodes meet: unturned with and without a limit on the second hash, turned, across formats."""

    def __init__(self, settings: list[Settings]):
        self.joint: dict[tuple[int, ...], int] = {}
        of = lambda name, keep: {c: getattr(s, name) for c, s in enumerate(settings) if keep(s)}
        # How far second hashes of unturned pairs of unlike first hashes may lie apart.
        second = {c: max(0, math.ceil(s.same_format_radius * s.dhash_factor - (1 if s.dhash_inclusive else 0)))
                  for c, s in enumerate(settings)}
        self.dual = Reach(of("same_format_radius", lambda s: s.use_dual_hash), self.joint, second)
        self.plain = Reach(of("same_format_radius", lambda s: not s.use_dual_hash), self.joint)
        self.turned = Reach(of("rotation_radius", lambda s: True), self.joint)
        self.cross = Reach(of("cross_format_radius", lambda s: True), self.joint)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


class Block:
    def __init__(self, data: bytes, width: int):
        self.data = np.frombuffer(data, np.int64).reshape(width, -1)
        self.node = self.data[0]
        self.hashes = self.data[4:8].view(np.uint64)
        self.dhash = self.data[9].view(np.uint64)
        self.missing = self.data[8]
        self.homes = self.data[len(FIXED):]
        kinds = self.data[1:4]
        cuts = np.flatnonzero(np.any(kinds[:, 1:] != kinds[:, :-1], axis=0)) + 1
        edges = [0, *cuts.tolist(), kinds.shape[1]]
        self.runs = {tuple(kinds[:, s].tolist()): (s, e) for s, e in zip(edges, edges[1:])}

    def turned(self, other: Block, rows: slice, span: slice) -> np.ndarray:
        """The least distance of a rotation of one side to the other side as it is; 64 and more where there is none."""
        least = np.full((rows.stop - rows.start, span.stop - span.start), 255, np.uint8)
        for k in range(3):
            for own, theirs, gone in (
                (self.hashes[k + 1][rows], other.hashes[0][span], (self.missing[rows] >> k & 1)[:, None]),
                (self.hashes[0][rows], other.hashes[k + 1][span], (other.missing[span] >> k & 1)[None, :]),
            ):
                d = _distances(own, theirs)
                if gone.any():
                    d = np.where(gone == 1, np.uint8(255), d)
                np.minimum(least, d, out=least)
        return least


def _meetings(a: Block, b: Block, same: bool) -> Iterator[tuple[slice, slice, bool, bool]]:
    """Rows of ``a`` and ``b`` of neighbouring shapes, whether their formats differ, and whether they are the same rows."""
    for (scope, bin_, raw), (start, end) in a.runs.items():
        for shift in (-1, 0, 1):
            for raw_b in (0, 1):
                found = b.runs.get((scope, bin_ + shift, raw_b))
                if found is None or same and found[0] < start:
                    continue
                size = max(1, CHUNK // (found[1] - found[0]))
                for low in range(start, end, size):
                    yield slice(low, min(low + size, end)), slice(*found), raw != raw_b, same and found[0] == start


def _nearest(d: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the ``NEAREST`` smallest distances of each row, as far as they are within the limit."""
    n = min(NEAREST, d.shape[1])
    best = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(n), (len(d), n))
    i, k = np.nonzero(np.take_along_axis(d, best, axis=1) <= limit)
    return i, best[i, k]


def _pairs(a: Block, b: Block, same: bool, reach: Reaches, nearest: bool, known: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Node pairs of two blocks that could pass: those nearest to each other, or all that are not ``known`` to be joined."""

    def apart(r: Reach, step: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = step < NONE
        if known:
            at = r.columns[step[need]]
            need[need] = a.homes[at, i[need]] != b.homes[at, j[need]]
        return need

    for rows, span, cross, alike in _meetings(a, b, same):
        if cross and reach.cross.widest < 0:
            continue
        up = _distances(a.hashes[0][rows], b.hashes[0][span])
        if alike:  # each pair once, and no node with itself
            up[np.arange(rows.start, rows.stop)[:, None] >= np.arange(span.start, span.stop)[None, :]] = 255
        dual = not cross and reach.dual.widest >= 0
        second = _distances(a.dhash[rows], b.dhash[span]) if dual and (nearest or reach.plain.widest < 0) else None
        turned = None
        if not cross:
            turned = a.turned(b, rows, span)
            if alike:
                turned[up == 255] = 255
        if nearest:
            ways = [(up, reach.cross.widest)] if cross else [(turned, reach.turned.widest), (up, reach.plain.widest)]
            if dual:
                ways.append((np.where(up == 0, 0, np.maximum(up, second)), reach.dual.widest))
            found = [_nearest(d, limit) for d, limit in ways if limit >= 0]
            for i, j in found:
                yield a.node[i + rows.start], b.node[j + span.start]
            continue
        if cross:
            i, j = np.nonzero(up <= reach.cross.widest)
        else:
            near = up <= reach.plain.widest if reach.plain.widest >= 0 else np.zeros(up.shape, bool)
            if dual:
                close = up <= reach.dual.widest
                near |= close & ((second <= reach.dual.widest_second) | (up == 0)) if second is not None else close
            near |= turned <= reach.turned.widest
            i, j = np.nonzero(near)
        if not len(i):
            continue
        d, ai, bj = up[i, j], i + rows.start, j + span.start
        if cross:
            need = apart(reach.cross, reach.cross.step[d], ai, bj)
        else:
            need = apart(reach.turned, reach.turned.step[turned[i, j]], ai, bj)
            need |= apart(reach.plain, reach.plain.step[d], ai, bj)
            if dual:
                dd = np.bitwise_count(a.dhash[ai] ^ b.dhash[bj])
                step = np.where(d == 0, reach.dual.step[d], np.maximum(reach.dual.step[d], reach.dual.second[dd]))
                need |= apart(reach.dual, step, ai, bj)
        yield a.node[ai[need]], b.node[bj[need]]


def block_size(n: int) -> int:
    return min(max(-(-n // BLOCKS), LEAST_BLOCK), LARGEST_BLOCK)


def _packed(dealt: DataFrame, keys: dict[str, str], width: int) -> DataFrame:
    """The ``keys`` (names and types) of a block with ``data``: all other columns as whole numbers, sorted by shape and format."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("scope_", "ascending"), ("bin", "ascending"), ("raw", "ascending")])
        columns = np.stack([table[c].to_numpy() for c in table.column_names[len(keys):]])
        assert len(columns) == width
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "data": [columns.tobytes()]})

    return dealt.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} {kind}" for k, kind in keys.items()) + ", data binary")


def _rows(shaped: DataFrame, scope: str | None, *more: Column) -> DataFrame:
    """The columns ``FIXED`` of nodes with their ``bin`` of shapes, behind ``more``."""
    whole = lambda c: c.cast("long")
    missing = sum((whole(F.col(r).isNull() | (F.col(r) == F.col("phash"))) * (1 << k) for k, r in enumerate(ROTATIONS)), F.lit(0))
    return shaped.filter("phash is not null").select(
        *more, "node_id", (F.xxhash64(F.col(scope).cast("string")) if scope else F.lit(0).cast("long")).alias("scope_"), "bin",
        whole(F.col("is_raw")).alias("raw"), "phash", *[F.coalesce(r, F.lit(0).cast("long")).alias(r) for r in ROTATIONS],
        whole(missing).alias("missing"), F.coalesce("dhash", F.lit(0).cast("long")).alias("dhash"))


def _comparer(width: int, reach: Reaches, nearest: bool, known: bool, symmetric: bool):
    """From batches of block pairs ``(i, j, data, other)`` to node pairs; with ``symmetric`` both sides are one table."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = symmetric and batch["i"][r].as_py() == batch["j"][r].as_py()
                a = Block(batch["data"][r].as_buffer(), width)
                b = a if same else Block(batch["other"][r].as_buffer(), width)
                for x, y in _pairs(a, b, same, reach, nearest, known):
                    if len(x):
                        x, y = (np.minimum(x, y), np.maximum(x, y)) if symmetric else (x, y)
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return compare


def near_nodes(shaped: DataFrame, n: int, settings: list[Settings], scope: str | None = None, nearest: bool = False,
               comps: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: nodes that some configuration could link, by hashes, format and shape.

    ``shaped`` are the ``n`` nodes with their ``bin`` of shapes. With ``nearest`` only the nearest ones in a few blocks;
    given the components ``comps (node, component)`` of vertices (node and configuration) only what they do not join.
    """
    reach = Reaches(settings)
    count = max(1, -(-n // block_size(n)))
    rows = _rows(shaped, scope)
    if comps is not None:
        rows = _with_homes(rows, comps, reach, len(settings))
    width = len(rows.columns)
    dealt = rows.select(F.pmod(F.xxhash64("node_id"), F.lit(count)).cast("int").alias("block"), *rows.columns)
    packed = materialise(_packed(dealt, {"block": "int"}, width), "blocks")
    first = F.col("block").alias("i")
    if nearest:
        meet = F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.lit(min(NEAREST_BLOCKS, count) - 1)), lambda k: F.pmod(F.col("block") + k, F.lit(count)).cast("int"))))
    else:
        meet = F.explode(F.sequence(F.col("block"), F.lit(count - 1)))
    cells = count * min(NEAREST_BLOCKS, count) if nearest else count * (count + 1) // 2
    left = packed.select(first, "data", meet.alias("j"))
    met = left.join(packed.select(F.col("block").alias("j"), F.col("data").alias("other")), "j")
    compare = _comparer(width, reach, nearest, comps is not None, True)
    return met.repartition(min(cells, 1024)).mapInArrow(compare, "a long, b long")


def placed_rows(shaped: DataFrame, n: int, scope: str, size: str) -> DataFrame:
    """``n`` nodes for :func:`near_of_scopes`, numbered by ``scope``, which has no more than ``size`` of them: those of a
    large scope are blocks of consecutive numbers, those of small scopes share blocks."""
    most = block_size(n)
    own = F.xxhash64(F.col(scope).cast("string"))
    large = F.col(size) > most
    home = F.when(large, own).otherwise(F.pmod(own, F.lit(-(-n // most))))
    part = F.when(large, F.expr(f"node_id div {most}")).otherwise(F.lit(0).cast("long"))
    return _rows(shaped, scope, home.alias("home"), part.alias("part"))


def near_of_scopes(left: DataFrame, right: DataFrame, settings: Settings, sizes: tuple[int, int], n: int) -> DataFrame:
    """``(a, b)``: nodes of two sides out of :func:`placed_rows` that could pass, each pair of one scope once. ``sizes`` are
    the numbers of nodes of the sides, of ``n`` in all."""
    symmetric = left is right
    keys = {"home": "long", "part": "long"}
    packs = [materialise(_packed(side.select(*keys, *FIXED), keys, len(FIXED)), "blocks") for side in ([left] if symmetric else [left, right])]
    side = lambda df, name, data: df.select("home", F.col("part").alias(name), *([F.col("data").alias(data)] if data else []))
    met = side(packs[0], "i", None).join(side(packs[-1], "j", None), "home")
    met = met.filter("i <= j") if symmetric else met
    met = met.join(side(packs[0], "i", "data"), ["home", "i"]).join(side(packs[-1], "j", "other"), ["home", "j"])
    cells = math.prod(-(-k // block_size(n)) + 1 for k in sizes)
    compare = _comparer(len(FIXED), Reaches([settings]), False, False, symmetric)
    return met.select("i", "j", "data", "other").repartition(min(cells, 1024)).mapInArrow(compare, "a long, b long")


def _with_homes(rows: DataFrame, comps: DataFrame, reach: Reaches, combos: int) -> DataFrame:
    """For each set of configurations that is looked at together, a hash of the components a node has under them."""
    vertex = F.struct(F.pmod("node", F.lit(combos)).cast("int").alias("k"), F.col("component").alias("v"))
    # As many entries as there are configurations.
    known = comps.groupBy(F.expr(f"node div {combos}").alias("node_id")).agg(F.map_from_entries(F.collect_list(vertex)).alias("of"))
    rows = rows.join(known, "node_id", "left")

    def home(c: int) -> Column:
        return F.coalesce(F.try_element_at("of", F.lit(c)), F.col("node_id") * combos + c)

    joint = [F.xxhash64(*[home(c) for c in own]).alias(f"home{k}") for own, k in reach.joint.items()]
    return rows.select(*FIXED, *joint)
