"""Near-duplicate classes of documents: MinHash tables with tensored keys, then exact checks on full shingle sets.

Two collections of ``SUBKEYS`` sub-keys each (``ROWS`` minhashes per sub-key) are computed. The key of table ``(i, j)``
combines sub-key ``i`` of the first collection with sub-key ``j`` of the second, so ``2 * SUBKEYS * ROWS`` minhashes
make ``SUBKEYS ** 2`` tables of ``2 * ROWS`` rows. A pair of similarity ``s`` is missed by all tables only if it agrees
in no sub-key of one collection: at most ``2 * (1 - s ** ROWS) ** SUBKEYS``, 0.0001 at 0.75.

Texts with equal shingle sets are one node before any key is made. A node that shares no sub-key leaves at once. Each
table cell has a pivot, its most widely shared member, and every member is checked against the pivot on full sets.

Two members of a cell that are not both linked to its pivot ``p`` may still be linked to each other. They are found
without listing pairs. With ``D(x)`` the shingles in exactly one of ``x`` and ``p``, the sets ``x`` and ``y`` differ in
``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` shingles, so a link needs a shared part of known size in ``D``, at least one
shingle whenever ``x`` or ``y`` is not linked to ``p``. That is an overlap join around one pivot: shingles met in one
``D`` only cannot be shared and drop out, the rest are ordered by rarity, prefixes are joined, size and position bounds
discard most of what meets, and the remaining pairs are checked on full sets.

Only what could still join two components needs a check. The links to the pivots are solved first; then the members that
share a shingle of their prefixes are checked against one of them (linear); and what is left meets between different
components only. A group of copies around a pivot that they are not linked to is one component by then, through pivots of
their own, and its members never meet each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.words import STEP, arrow_batches, as_text, by_bytes, mixed, split_words, window_hashes, word_hashes
from twinframe.operators.components import connected_components, extend_components
from twinframe.session import materialise

SHINGLE = 5
SIMILARITY = 75  # per cent
SUBKEYS = 12
ROWS = 2
CHUNK = 1 << 16
BATCH_ROWS = 1000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle, no words none."""
    offsets, words = split_words(pc.ascii_lower(texts))
    hashes = word_hashes(words)
    windows = mixed(window_hashes(hashes, size))
    out = []
    for s, e in zip(offsets[:-1], offsets[1:]):
        if e - s >= size:
            out.append(np.unique(windows[s:e - size + 1]))
        elif e > s:
            joined = b" ".join(words.slice(s, e - s).cast(pa.binary()).to_pylist())
            out.append(np.array([xxhash.xxh3_64_intdigest(joined, seed=int(e - s))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` minhashes of each non-empty set, one row per set."""
    out = np.empty((len(sets), count), np.uint64)
    factors = mixed(np.arange(1, count + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    start = 0
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    while start < len(sets):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        values = np.concatenate(sets[start:stop])
        starts = ends[start:stop] - sizes[start:stop] - base
        work = np.empty_like(values)
        for k in range(count):
            np.multiply(values, factors[k], out=work)
            np.bitwise_xor(work, work >> np.uint64(32), out=work)
            np.multiply(work, factors[count - 1 - k], out=work)
            out[start:stop, k] = np.minimum.reduceat(work, starts)
        start = stop
    return out


def subkeys(sets: list[np.ndarray], groups: int, rows: int) -> np.ndarray:
    """``groups`` sub-keys per set, each of ``rows`` minhashes and its own place, so no two places share a key."""
    values = minhashes(sets, groups * rows).reshape(len(sets), groups, rows)
    keys = np.broadcast_to(np.arange(groups, dtype=np.uint64), (len(sets), groups)).copy()
    for r in range(rows):
        keys = mixed(keys * STEP + values[:, :, r])
    return keys


def _set_id(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _signatures(documents: DataFrame, size: int, groups: int, rows: int) -> DataFrame:
    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def sign(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                sets = shingle_sets(as_text(batch.column("text")), size)
                filled = [k for k, s in enumerate(sets) if len(s)]
                keys = subkeys([sets[k] for k in filled], groups, rows).view(np.int64)
                lists: list = [None] * len(sets)
                for row, k in enumerate(filled):
                    lists[k] = keys[row]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_id": pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary()),
                    "keys": pa.array(lists, pa.list_(pa.int64())),
                })

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        sign, f"doc_id {kind}, text_hash long, n_shingles long, set_id binary, keys array<long>"
    )


def _cells(nodes: DataFrame, groups: int) -> DataFrame:
    """``cell, node, weight``: the table cells of every node that shares a sub-key of both collections."""
    single = nodes.select("node", F.posexplode("keys").alias("place", "key"))
    shared = materialise(
        single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared"
    )
    of_node = single.join(shared, "key").groupBy("node").agg(
        F.collect_list(F.when(F.col("place") < groups, F.col("key"))).alias("left"),
        F.collect_list(F.when(F.col("place") >= groups, F.col("key"))).alias("right"),
        F.sum("n").alias("weight"),
    )
    half = of_node.select("node", "weight", F.explode("left").alias("a"), "right")
    return half.select("node", "weight", "a", F.explode("right").alias("b")).select(
        F.xxhash64("a", "b").alias("cell"), "node", "weight"
    )


def _sets(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, n, shingles`` of the given nodes, from the text of the row that stands for each."""
    texts = documents.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("rep_hash"), "text")
    source = nodes.join(
        texts, nodes["rep"].eqNullSafe(texts["rep"]) & (nodes["rep_hash"] == texts["rep_hash"])
    ).select("node", "set_id", "text")

    def build(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                sets = shingle_sets(as_text(batch.column("text")), size)
                right = [k for k, wanted in enumerate(batch.column("set_id").to_pylist()) if _set_id(sets[k]) == wanted]
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node").take(pa.array(right, pa.int64())),
                    "n": pa.array([len(sets[k]) for k in right], pa.int64()),
                    "shingles": pa.array([sets[k].tobytes() for k in right], pa.binary()),
                })

    return source.mapInArrow(build, "node long, n long, shingles binary").dropDuplicates(["node"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _compared(pairs: DataFrame, sets: DataFrame, similarity: int, deltas: bool) -> DataFrame:
    """``src, dst, n, linked`` for each pair, with ``delta`` (what only one of both has, as hashes of the shingle and
    ``dst``) where it is asked for; ``n`` is the size of ``src``."""
    left = sets.select(F.col("node").alias("src"), F.col("n"), F.col("shingles").alias("s_src"))
    right = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("s_dst"))
    both = pairs.join(left, "src").join(right, "dst").select("src", "dst", "n", "s_src", "s_dst")

    def compare(batches):
        for b in batches:
            linked, delta = [], []
            pivots = np.asarray(b.column("dst")).view(np.uint64)
            for k, (x, y) in enumerate(zip(b.column("s_src"), b.column("s_dst"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = common(x, y)
                linked.append(100 * inter >= similarity * (len(x) + len(y) - inter))
                if deltas:
                    different = np.setxor1d(x, y, assume_unique=True)
                    delta.append(mixed(different ^ mixed(pivots[k:k + 1] + STEP)).view(np.int64))
            out = {"src": b.column("src"), "dst": b.column("dst"), "n": b.column("n"), "linked": pa.array(linked, pa.bool_())}
            if deltas:
                out["delta"] = pa.array(delta, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    return both.mapInArrow(compare, "src long, dst long, n long, linked boolean" + ", delta array<long>" * deltas)


def _heads(checked: DataFrame, similarity: int) -> DataFrame:
    """``item, src, linked, g, size, at``: the prefixes of what members differ in from a pivot, where at least one member
    around it is not linked to it."""
    apart, joint = 100 - similarity, 100 + similarity
    surplus = F.size("delta") * joint - F.col("n") * apart  # a link needs shared * 2 * joint >= the sum of both
    members = checked.withColumn("g", surplus.cast("long"))
    least = members.groupBy("dst").agg(
        F.min("g").alias("g_any"), F.min(F.when(~F.col("linked"), F.col("g"))).alias("g_apart"), F.count("g").alias("size")
    ).filter("g_apart is not null and size > 1")
    members = members.join(least, "dst").withColumn(
        "g_other", F.when(F.col("linked"), F.col("g_apart")).otherwise(F.col("g_any"))
    )
    members = materialise(members.select("src", "dst", "linked", "g", "g_other", "delta"), "around")
    items = members.select("src", "dst", F.explode("delta").alias("item"))
    common_items = materialise(
        items.groupBy("item").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"), "common"
    )
    ordered = items.join(common_items, "item").groupBy("src", "dst").agg(
        F.array_sort(F.collect_list(F.struct("met", "item"))).alias("items")
    )
    needed = lambda g: F.greatest(F.lit(1), F.ceil(g / (2 * joint)))
    size = F.size("items").cast("long")
    prefix = (size - needed(F.col("g") + F.col("g_other")) + 1).cast("int")
    heads = members.drop("delta").join(ordered, ["src", "dst"]).withColumn("size", size).withColumn("prefix", prefix)
    heads = heads.filter("prefix > 0").select(
        "src", "linked", "g", "size", F.posexplode(F.slice("items", 1, F.col("prefix"))).alias("at", "head")
    ).select("src", "linked", "g", "size", "at", F.col("head.item").alias("item"))
    return materialise(heads, "heads")


def _may_link(similarity: int):
    """Whether heads ``a`` and ``b`` of one item may be linked: at least one is not linked to the pivot, and the sizes and
    positions leave room for what they must share."""
    joint = 100 + similarity
    room = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("a.g") + F.col("b.g")) / (2 * joint)))
    return ~(F.col("a.linked") & F.col("b.linked")) & (needed <= room)


def _placed(heads: DataFrame, components: DataFrame) -> DataFrame:
    """Heads with the component of their node; a node without one is its own."""
    known = components.select(F.col("node").alias("src"), "component")
    return heads.join(known, "src", "left").withColumn("component", F.coalesce("component", "src"))


def _first_of_items(heads: DataFrame, similarity: int) -> DataFrame:
    """``src, dst``: members that share an item, each against the first of them; both in different components."""
    first = heads.groupBy("item").agg(F.min(F.struct("src", "linked", "g", "size", "at", "component")).alias("b")).alias("f")
    met = heads.alias("a").join(first.select("item", "b"), "item").filter((F.col("a.component") != F.col("b.component")) & _may_link(similarity))
    return met.select(F.col("a.src").alias("src"), F.col("b.src").alias("dst")).distinct()


def _members_met(heads: DataFrame, similarity: int) -> DataFrame:
    """``item, a, cb``: heads and the later components they may be linked with through ``item``. Components meet first, so
    members of one component are never paired, and a member of a large one is met only where its own size and position
    leave room for the other's most favourable member."""
    # The bounds of two components are those of their most favourable members.
    room = (F.col("size") - F.col("at")).alias("room")
    there = heads.select("item", "component", "g", "linked", room).groupBy("item", "component").agg(
        F.min("g").alias("g"), F.max("room").alias("room"), F.min("linked").alias("linked"))
    x, y = there.alias("x"), there.alias("y")
    needed = lambda g, h: F.greatest(F.lit(1), F.ceil((g + h) / (2 * (100 + similarity))))
    may = (F.col("x.component") < F.col("y.component")) & ~(F.col("x.linked") & F.col("y.linked")) & (
        needed(F.col("x.g"), F.col("y.g")) <= F.least(F.col("x.room"), F.col("y.room")))
    meets = x.join(y, (F.col("x.item") == F.col("y.item")) & may).select(
        F.col("x.item").alias("item"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"),
        F.struct("y.g", "y.room", "y.linked").alias("other")).alias("m")
    side = heads.select(F.col("item").alias("item_a"), F.col("component").alias("ca_a"), F.struct("src", "linked", "g", "size", "at").alias("a"))
    own = ~(F.col("a.linked") & F.col("other.linked")) & (
        needed(F.col("a.g"), F.col("other.g")) <= F.least(F.col("a.size") - F.col("a.at"), F.col("other.room")))
    return meets.join(side, (F.col("item") == F.col("item_a")) & (F.col("ca") == F.col("ca_a")) & own).select("item", "a", "cb")


def _between_components(heads: DataFrame, similarity: int) -> DataFrame:
    """``src, dst``: pairs that share an item and may be linked, of different components."""
    b = heads.select("item", F.col("component").alias("cb"), F.struct("src", "linked", "g", "size", "at").alias("b"))
    met = _members_met(heads, similarity).join(b, ["item", "cb"]).filter(_may_link(similarity))
    return met.select(F.col("a.src").alias("src"), F.col("b.src").alias("dst")).distinct()


def _components(checked: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``node, component`` of all links, from the checks against the pivots."""
    components = materialise(connected_components(checked.filter("linked").select("src", "dst")), "components")
    heads = _heads(checked, similarity)
    if heads.isEmpty():
        return components
    for pick in (_first_of_items, _between_components):
        pairs = materialise(pick(_placed(heads, components), similarity), "pairs")
        found = _compared(pairs, sets, similarity, deltas=False).filter("linked").select("src", "dst")
        components = extend_components(components, materialise(found, "links"))
    return components


def _classes(documents, similarity, size, groups, rows) -> tuple[DataFrame, DataFrame]:
    """Every row with its set, and the component of each set that is shared or linked."""
    signed = materialise(_signatures(documents, size, 2 * groups, rows), "signatures")
    nodes = signed.filter("set_id is not null").groupBy("set_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("top"),
        F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"),
    )
    nodes = materialise(nodes.select(
        F.monotonically_increasing_id().alias("node"), F.col("top.doc_id").alias("rep"),
        F.col("top.text_hash").alias("rep_hash"), "set_id", "keys", "copies",
    ), "nodes")
    cells = materialise(_cells(nodes, groups), "cells")
    pivots = materialise(
        cells.groupBy("cell").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("cell", F.col("top.node").alias("dst")), "pivots")
    stars = materialise(
        cells.join(pivots, "cell").select(F.col("node").alias("src"), "dst").filter("src <> dst").distinct(), "stars")
    needed = stars.select(F.col("src").alias("node")).union(stars.select("dst")).distinct()
    sets = materialise(_sets(documents, nodes.drop("keys").join(needed, "node"), size), "sets")
    checked = materialise(_compared(stars, sets, similarity, deltas=True), "checked")
    components = _components(checked, sets, similarity)
    named = components.join(nodes.select("node", "rep"), "node")
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = named.join(names, "component").select("node", "component_id")
    classes = nodes.select("node", "set_id", "rep", "copies").join(linked, "node", "left").filter(
        F.col("component_id").isNotNull() | (F.col("copies") > 1)
    ).select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    classes = materialise(classes, "classes")
    return signed, classes


def _judged(documents, similarity, size, groups, rows) -> DataFrame:
    with arrow_batches(documents.sparkSession, BATCH_ROWS):
        signed, classes = _classes(documents, similarity, size, groups, rows)
    own = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(classes, "set_id", "left").select(
        "doc_id", "text_hash", "n_shingles", own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"),
    )


def near_duplicates(documents: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE,
                    groups: int = SUBKEYS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents (doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text's set is its distinct shingles of ``size`` words,
    a shorter text is one shingle, and null, empty or blank texts have none and are linked with nothing. Rows are
    linked when their similarity is at least ``similarity`` per cent, confirmed on the full sets; ``component_id`` is
    the smallest ``doc_id`` that links reach, ``kept`` says that it is the row's own. Rows that repeat a ``doc_id`` with
    an equal text all carry the same result. A row without ``doc_id`` takes part and is kept only where no row with
    one is reachable. An empty table gives no rows, and other columns are not read.
    """
    return _judged(documents, similarity, size, groups, rows).drop("text_hash")


def deduplicated(documents: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE,
                 groups: int = SUBKEYS, rows: int = ROWS) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, with all their columns; one row of each ``doc_id`` and
    text."""
    kept = _judged(documents, similarity, size, groups, rows).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    texts = documents.withColumn("__text_hash", F.xxhash64("text"))
    near = texts["doc_id"].eqNullSafe(kept["kept_id"]) & (texts["__text_hash"] == kept["kept_hash"])
    return texts.join(kept, near, "left_semi").dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
