"""Radius join of 64-bit hashes as an ordinary equi-join.

Two hashes that differ in at most ``r`` bits, cut into ``m > r`` bands, agree on at least ``m - r`` whole bands.
So each side is keyed by every choice of ``m - r`` bands (a bit mask), and the join is on a 64-bit hash of
``(class, bin, mask number, hash & mask)``; a chance meeting there is told apart by class, bin and distance. For wide
radii the 64 bits are first cut into ``g`` groups, one of which must hold at most ``r // g`` of the differing bits. More
masks mean longer keys and fewer chance meetings; the number of hashes decides what is cheapest.

A key that many hashes share is found by a count of keys (over a part of the hashes chosen by their value) and refined
alone: its pairs agree on its bits, so the bits outside are cut into bands again and the key is extended by two of them.
What is still crowded, and bins joined without any bits, is cut into a square of blocks, so copies grow with the root of
the pairs. Keys that are not crowded are joined as they are.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import materialise

MAX_MASKS = 300
ROW_COST = 20.0  # an exploded, shuffled row against one comparison
KEY_PAIRS = 20_000_000  # comparisons that may meet on one key
COUNTED = 16  # one hash out of so many is counted to find crowded keys: those have thousands


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _bands(low: int, high: int, m: int) -> list[int]:
    cuts = [low + (high - low) * i // m for i in range(m + 1)]
    return [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]


def masks_for(radius: int, groups: int, bands: int) -> list[int]:
    """All masks of a scheme. ``groups = 0`` is the scheme without bits: everything meets everything."""
    if groups == 0:
        return [0]
    keep = bands - radius // groups
    out = []
    for g in range(groups):
        cut = _bands(64 * g // groups, 64 * (g + 1) // groups, bands)
        out += [_signed(sum(chosen)) for chosen in combinations(cut, keep)]
    return out


def plan_masks(radius: int, rows: int, meetings: float) -> list[int]:
    """The cheapest scheme for a radius, the rows to key, and the pairs that meet if no hash bit is in the key."""
    best, best_cost = (0, 1), ROW_COST * rows + float(meetings)
    if radius >= 64:
        return [0]
    for groups in (1, 2, 3, 4):
        errors = radius // groups
        width = 64 // groups
        for bands in range(errors + 1, min(errors + 12, width) + 1):
            n = groups * comb(bands, bands - errors)
            if n > MAX_MASKS:
                break
            bits = width * (bands - errors) // bands
            cost = ROW_COST * n * rows + float(meetings) * n / 2.0**bits
            if cost < best_cost:
                best, best_cost = (groups, bands), cost
    return masks_for(radius, *best)


def _shifted(df: DataFrame, shifts: list[int]) -> DataFrame:
    """``cls`` and ``bin`` of each cell as join keys, one row per allowed offset."""
    return df.select(
        *df.columns, F.col("cell.cls").alias("cls"),
        F.explode(F.array(*[F.col("cell.bin") + F.lit(s).cast("long") for s in shifts])).alias("bin"),
    )


def _reach(left: DataFrame, right: DataFrame, offsets: list[int]) -> tuple[int, float, float]:
    """Rows on both sides, pairs of cells within bins, and the most such pairs in one bin."""
    count = lambda df, shifts, name: _shifted(df, shifts).groupBy("cls", "bin").agg(F.count(F.lit(1)).alias(name))
    met = count(left, offsets, "l").join(count(right, [0], "r"), ["cls", "bin"], "full").na.fill(0, ["l", "r"])
    pairs = F.col("l").cast("double") * F.col("r")
    row = met.agg(F.sum(F.col("l") + F.col("r")), F.sum(pairs), F.max(pairs)).first()
    return int(row[0] or 0), row[1] or 0.0, row[2] or 0.0


def near_hashes(left: DataFrame, right: DataFrame, radius: int, offsets: list[int], symmetric: bool,
                at_most: int | tuple[int, int] | None = None, second: int | None = None, beyond: int = -1,
                one_in: int = 1) -> DataFrame:
    """Pairs of cells ``(u, v)`` in one class whose bins are an allowed offset apart and whose hashes are near.

    ``left`` and ``right`` hold a ``cell`` struct ``(kind, cls, bin, hash)``, one row per distinct cell. With
    ``symmetric`` both are the same table: every unordered pair of different cells is returned once. The keys are
    planned from the pairs that can meet, or without looking where ``at_most`` cells on a side (or on each) are known.

    Further columns narrow what is returned. Cells of the same ``home`` do not meet (a null home meets all). With
    ``second``, cells come once for each ``dhash`` they have, two of which must lie within that radius; these bits are in
    the keys as well. Pairs within ``beyond`` are left out. ``one_in`` returns a fixed part of the pairs, chosen by hash.
    """
    if at_most:
        here, there = at_most if isinstance(at_most, tuple) else (at_most, at_most)
        rows, meetings, busiest = here + there, here * there, here * there
    else:
        rows, meetings, busiest = _reach(left, right, offsets)
    seconds = masks_for(second, 1, second + 1) if second is not None else [0]
    # The bits of real hashes hang together: about a third of them tells.
    chance = 2.0 ** -(64 // (second + 1) // 3) if second is not None else 1.0
    masks = plan_masks(radius, rows * len(seconds), meetings * chance * len(seconds))
    seconds = seconds * len(masks)
    masks = [m for m in masks for _ in range(len(seconds) // len(masks))]
    lhs, rhs, on = _dealt(left, right, radius, offsets, masks, busiest, seconds if second is not None else None)
    diff = F.col("u.hash").bitwiseXOR(F.col("v.hash"))
    distance = F.bit_count(diff)
    met = F.col("v.bin") - F.col("u.bin")
    pairs = lhs.join(rhs, on).filter((distance <= radius) & (distance > beyond))
    pairs = pairs.filter((F.col("u.cls") == F.col("v.cls")) & met.isin(offsets))
    if second is not None:
        diff2 = F.col("u_dhash").bitwiseXOR(F.col("v_dhash"))
        pairs = pairs.filter(F.bit_count(diff2) <= second)
    if "home" in left.columns:
        pairs = pairs.filter(F.coalesce(F.col("u_home") != F.col("v_home"), F.lit(True)))
    if one_in > 1:
        pairs = pairs.filter(F.pmod(F.xxhash64("u.hash", "v.hash"), F.lit(one_in)) == 0)
    if symmetric:
        pairs = pairs.filter((F.col("u.bin") != F.col("v.bin")) | (F.col("u.hash") < F.col("v.hash")))
    if len(masks) > 40 or second is not None:
        return pairs.select("u", "v").distinct()
    # Keep a pair only under the first mask it meets on, and the first refinement: no second shuffle to remove repeats.
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = pairs.filter(F.col("no") == first)
    if "sub" in on:
        agrees = F.transform(_refinements(masks, radius), lambda m: diff.bitwiseAND(m) == 0)
        pairs = pairs.filter((F.col("sub") < 0) | (F.array_position(agrees, True) - 1 == F.col("sub")))
    return pairs.select("u", "v")


def meeting_others(left: DataFrame, right: DataFrame, radius: int, offsets: list[int], symmetric: bool,
                   at_most: int | None = None) -> DataFrame:
    """:func:`near_hashes` of cells with a ``home``, where most of the dense places have one home.

    Cells of the commonest home are joined with the others only, so the work is not that of all that is near.
    """
    top = right.filter("home is not null").groupBy("home").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "home")))
    top = top.first()[0]
    if top is None:
        return near_hashes(left, right, radius, offsets, symmetric, at_most)
    inside = F.coalesce(F.col("home") == F.lit(top["home"]), F.lit(False))
    others = right.filter(~inside)
    back = near_hashes(left.filter(inside), others, radius, [-1, 0, 1] if symmetric else offsets, False, at_most)
    if symmetric:
        return near_hashes(others, others, radius, offsets, True, at_most).union(back)
    return near_hashes(left.filter(~inside), right, radius, offsets, False, at_most).union(back)


def _dealt(left: DataFrame, right: DataFrame, radius: int, offsets: list[int], masks: list[int],
           busiest: float, seconds: list[int] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their keys, as ``u`` and ``v``, and the key columns: at most about ``KEY_PAIRS`` pairs to a key."""

    def keyed(df: DataFrame, name: str, shifts: list[int]) -> DataFrame:
        # One long as the first key: rows are sorted by its bytes, not by the class that all of them share.
        bits = lambda i, m: [F.col("cell.hash").bitwiseAND(F.lit(m)),
                             *([F.col("dhash").bitwiseAND(F.lit(seconds[i]))] if seconds else [])]
        keys = F.array(*[
            F.struct(F.xxhash64("cls", "bin", F.lit(i), *bits(i, m)).alias("key"), F.lit(i).alias("no"))
            for i, m in enumerate(masks)
        ])
        more = [F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "cell"]
        df = _shifted(df, shifts).withColumn("keys", F.explode(keys))
        return df.select(F.col("cell").alias(name), *more, "keys.*")

    lhs, rhs = keyed(left, "u", offsets), keyed(right, "v", [0])
    on = ["key", "no"]
    if busiest <= KEY_PAIRS:  # pairs of a whole bin, so no key has more
        return lhs, rhs, on
    crowded = _crowded(lhs, rhs, on)
    if crowded.isEmpty():
        return lhs, rhs, on
    if _refines(masks, radius):
        def refined(df: DataFrame, name: str) -> DataFrame:
            own = _refinements(masks, radius)
            keys = F.transform(own, lambda m, i: F.struct(i.cast("int").alias("sub"), F.col(f"{name}.hash").bitwiseAND(m).alias("rest")))
            plain = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")))
            df = df.join(crowded.select(*on, F.lit(True).alias("hot")), on, "left")
            df = df.withColumn("k", F.explode(F.when(F.col("hot"), keys).otherwise(plain)))
            return df.select(*[c for c in df.columns if c not in ("hot", "k")], F.col("k.sub").alias("sub"), F.col("k.rest").alias("rest"))

        lhs, rhs, on = refined(lhs, "u"), refined(rhs, "v"), [*on, "sub", "rest"]
        crowded = _crowded(lhs.filter("sub >= 0"), rhs.filter("sub >= 0"), on)
        if crowded.isEmpty():
            return lhs, rhs, on
    one = F.coalesce("side", F.lit(1))
    block = lambda name: F.pmod(F.xxhash64(f"{name}.hash"), one).cast("int")
    every = F.explode(F.sequence(F.lit(0), one - 1))
    lhs = lhs.join(crowded, on, "left").withColumn("row_block", block("u")).withColumn("column_block", every).drop("side")
    rhs = rhs.join(crowded, on, "left").withColumn("column_block", block("v")).withColumn("row_block", every).drop("side")
    return lhs, rhs, [*on, "row_block", "column_block"]


def _crowded(lhs: DataFrame, rhs: DataFrame, on: list[str]) -> DataFrame:
    """Keys on which more than ``KEY_PAIRS`` pairs meet, with the ``side`` of a square of blocks of that size each."""
    part = lambda df, name: df.filter(F.pmod(F.xxhash64(f"{name}.hash", F.lit(1)), F.lit(COUNTED)) == 0)
    count = lambda df, name, n: part(df, name).groupBy(*on).agg((F.count(F.lit(1)) * COUNTED).cast("double").alias(n))
    pairs = F.col("l") * F.col("r")
    met = count(lhs, "u", "l").join(count(rhs, "v", "r"), on).filter(pairs > KEY_PAIRS)
    return materialise(met.select(*on, F.ceil(F.sqrt(pairs / KEY_PAIRS)).cast("int").alias("side")), "crowded")


def _outside(mask: int, radius: int) -> list[int]:
    """Pairs of bands of the bits outside ``mask``: hashes within ``radius`` that agree on ``mask`` agree on one of them."""
    bits = [b for b in range(64) if not mask >> b & 1]
    bands = radius + 2
    cut = [sum(1 << b for b in bits[len(bits) * i // bands:len(bits) * (i + 1) // bands]) for i in range(bands)]
    return [_signed(a | b) for a, b in combinations(cut, 2)]


def _refines(masks: list[int], radius: int) -> bool:
    """Whether two more bands leave clearly fewer chance meetings than the copies they cost."""
    free = min(64 - bin(m & (2**64 - 1)).count("1") for m in masks)
    return free > 0 and comb(radius + 2, 2) * 8 <= 2 ** min(2 * (free // (radius + 2)), 30)


def _refinements(masks: list[int], radius: int) -> Column:
    """The masks that refine the key of the row's mask number."""
    lists = [F.array(*[F.lit(m).cast("long") for m in _outside(mask, radius)]) for mask in masks]
    return F.get(F.array(*lists), F.col("no"))


def mask_keys(hash_column: Column, radius: int) -> Column:
    """An array of ``(no, bits)`` keys for an additional radius condition inside another join."""
    masks = masks_for(radius, 1, radius + 1) if radius < 8 else [0]
    return F.array(*[
        F.struct(F.lit(i).alias("no"), hash_column.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)
    ])
