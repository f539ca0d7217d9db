"""Similarity groups of a feature table: collapse, near hashes, links, components."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.config import PAIR_FIELDS, AtThreshold, Params, Settings, settings_grid
from twinframe.functions.hashing import ROTATIONS
from twinframe.operators.blocks import near_nodes
from twinframe.operators.candidates import meeting_others, near_hashes
from twinframe.operators.components import connected_components, extend_components
from twinframe.operators.links import Linker
from twinframe.operators.predicates import PairRule, aspect_ratio, borderline_pair
from twinframe.session import materialise

PAIR_COLUMNS = [
    "is_raw", "width", "height", "phash", *ROTATIONS, "dhash", "brightness", "histogram", "hist_entropy", "exif_date",
]

STAGED = 20_000  # nodes from which near cells are listed in stages
STAGES = [2, 4]  # the radii before the widest one
FIRST_PART = 16  # one pair out of so many makes the first stage where near pairs do not count
BLOCKED = 20_000, 2_000_000  # nodes between which settings wider than the stages let nodes meet in blocks
MOST_BLOCKED = 1_000_000  # nodes up to which other settings do: comparisons grow with the square, stages with less
NEAREST_FIRST = 2_000  # nodes from which the nearest ones are linked before all blocks meet


def ratio_bin(ratio_log: Column, tolerance_pct: float) -> Column:
    """Bins such that ratios within the tolerance fall in the same or a neighbouring bin. Width 0 stands apart."""
    tol = tolerance_pct / 100.0
    if tol >= 1:
        return F.lit(0).cast("long")
    width = max(-math.log(1.0 - tol) * (1 + 1e-9), 1e-9)
    return F.coalesce(F.floor(ratio_log / F.lit(width)), F.lit(-10**15)).cast("long")


def shape_log(r: Column, turned: bool = True) -> Column:
    """``ln(width/height)``, without sign when turned shapes count as the same; null for width 0."""
    ratio = aspect_ratio(r)
    value = F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio)))
    return F.abs(value) if turned else value


def collapse(features: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows alike in ``columns`` become one node: ``(nodes, membership(image_id, node_id))``.

    The signature is a SHA-256 over all the columns; grouping by it combines map-side, so any number of copies
    reduces to one row per task before the shuffle.
    """
    shown = [F.col(c).cast("string").alias(c) if c == "exif_date" else F.col(c) for c in columns]
    signed = features.select("image_id", *columns, F.sha2(F.to_json(F.struct(*shown)), 256).alias("sig"))
    nodes = signed.groupBy("sig").agg(
        *[F.first(c).alias(c) for c in columns], F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies")
    )
    nodes = materialise(nodes.withColumn("node_id", F.monotonically_increasing_id()), "nodes")
    membership = signed.select("image_id", "sig").join(nodes.select("sig", "node_id"), "sig").drop("sig")
    return nodes.drop("sig"), membership


def cell(kind: str, cls: Column, bin_: Column, hash_: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), cls.cast("string").alias("cls"), bin_.alias("bin"), hash_.alias("hash")
    )


def _components_of(nodes: DataFrame, edges: DataFrame, combos: int, alone: DataFrame | None = None) -> DataFrame:
    """:func:`_named_components` of the edges ``(src, dst)`` between vertices."""
    return _named_components(nodes, connected_components(edges), combos, alone)


def _named_components(nodes: DataFrame, comps: DataFrame, combos: int, alone: DataFrame | None = None) -> DataFrame:
    """``(node_id, combo_id, component)`` from components of vertices; named by the smallest image in each.

    ``alone(node_id, combo_id)`` lists the nodes that stand for several rows alike to each other: those form a
    component even without an edge.
    """
    comps = comps.select(
        F.expr(f"node div {combos}").alias("node_id"),  # whole numbers throughout: ids pass 2^53
        F.pmod(F.col("node"), F.lit(combos)).cast("int").alias("combo_id"),
        "component",
    )
    named = nodes.select("node_id", "image_id")
    linked = comps.join(named, "node_id")
    names = linked.groupBy("component").agg(F.min("image_id").alias("name"))
    linked = comps.join(names, "component").select("node_id", "combo_id", F.col("name").alias("component"))
    if alone is None:
        return linked
    every = alone.join(nodes.select("node_id", F.col("image_id").alias("component")), "node_id")
    return linked.unionByName(every.join(linked, ["node_id", "combo_id"], "left_anti"))


def _homes(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The distinct cells of ``members(node_id, cell)``; given components, with the one all its nodes are in as ``home``."""
    if comps is None:
        return members.select("cell").distinct()
    names = comps.select(F.col("node").alias("node_id"), "component")
    named = members.join(names, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    ends = named.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return materialise(ends.select("cell", F.expr("if(low = high, low, null)").alias("home")), "homes")


def _dhash_radius(settings: list[Settings]) -> int | None:
    """How far dHashes of unturned pairs of one format and different pHashes may lie apart, where all settings limit it."""
    if not all(s.use_dual_hash for s in settings):
        return None
    limit = max(s.same_format_radius * s.dhash_factor - (1 if s.dhash_inclusive else 0) for s in settings)
    return max(0, math.ceil(limit))


def shape_bin(settings: list[Settings]) -> Column:
    return ratio_bin(shape_log(F.struct("width", "height")), max(s.ar_tolerance_pct for s in settings))


def _cells(nodes: DataFrame, settings: list[Settings], scope: str | None) -> tuple[DataFrame, DataFrame]:
    """``(node_id, cell)`` of the hashes as they are and of the turned ones."""
    shaped = nodes.withColumn("bin", shape_bin(settings))
    within = F.concat(F.col(scope).cast("string"), F.lit(":")) if scope else F.lit("")
    shaped = shaped.withColumn("cls", F.concat(within, F.col("is_raw").cast("string")))
    upright = shaped.select("node_id", cell("U", F.col("cls"), F.col("bin"), F.col("phash")).alias("cell"))
    turned = shaped.select(
        "node_id", "cls", "bin", "phash", F.explode(F.array_distinct(F.array(*ROTATIONS))).alias("hash")
    ).filter("hash is not null and hash <> phash")
    return upright, turned.select("node_id", cell("R", F.col("cls"), F.col("bin"), F.col("hash")).alias("cell"))


def node_cells(nodes: DataFrame, settings: Settings, scope: str) -> DataFrame:
    """``(node_id, cell, dhash)``: all cells of all nodes, for :func:`near_between`."""
    upright, turned = _cells(nodes, [settings], scope)
    return upright.union(turned).join(nodes.select("node_id", "dhash"), "node_id")


def near_between(left: DataFrame, right: DataFrame, settings: Settings, sizes: tuple[int, int]) -> DataFrame:
    """``(u, v)``: near cells of the pair rule between two sides ``(cell, dhash)`` out of :func:`node_cells`, those that
    both sides have included. With one table on both sides each unordered pair comes once. ``sizes`` are the numbers
    of nodes."""
    symmetric, (n, m) = left is right, sizes
    of = lambda side, kind: side.filter(F.col("cell.kind") == kind).select("cell").distinct()
    ups, turns = [of(side, "U") for side in (left, right)], [of(side, "R") for side in (left, right)]
    if symmetric:
        ups[1] = ups[0]
    offsets, second, radius = [0, 1] if symmetric else [-1, 0, 1], _dhash_radius([settings]), settings.same_format_radius
    if second is not None and second < 8:
        twice = [side.filter("cell.kind = 'U'").select("cell", "dhash").distinct() for side in (left, right)]
        twice = twice[:1] * 2 if symmetric else twice
        # Equal hashes need no near dHash.
        found = [near_hashes(*twice, radius, offsets, symmetric, sizes, second), near_hashes(*ups, 0, offsets, symmetric, sizes)]
    else:
        found = [near_hashes(*ups, radius, offsets, symmetric, sizes)]
    if symmetric:
        found.append(ups[0].select(F.col("cell").alias("u"), F.col("cell").alias("v")))
    found.append(near_hashes(turns[0], ups[1], settings.rotation_radius, [-1, 0, 1], False, (3 * n, m)))
    if not symmetric:
        found.append(near_hashes(ups[0], turns[1], settings.rotation_radius, [-1, 0, 1], False, (n, 3 * m)))
    for flags in (("true", "false"), ("false", "true"))[:1 if symmetric else 2]:
        sides = [df.filter(F.col("cell.cls").endswith(f)).withColumn("cell", _as_class("cell", f, "x")) for df, f in zip(ups, flags)]
        cross = near_hashes(*sides, settings.cross_format_radius, [-1, 0, 1], False, sizes)
        found.append(cross.select(*[_as_class(c, "x", f).alias(c) for c, f in zip("uv", flags)]))
    return reduce(DataFrame.union, found)


def _as_class(name: str, old: str, new: str) -> Column:
    return F.col(name).withField("cls", F.regexp_replace(f"{name}.cls", f"{old}$", new))


def pair_cells(nodes: DataFrame, settings: list[Settings], scope: str | None = None, at_most: int | None = None,
               nearest: int = 64, done: int = -1, comps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members and near cells for the pair rule: same format, cross format, and rotated. Only nodes equal in the
    column ``scope`` meet. ``at_most`` is a number of nodes that need not be counted again. Pairs farther than ``nearest``
    are left out, and those within one of the components ``comps (node, component)``, which hold all pairs up to the radius
    ``done``. Unturned pairs of one format need near dHashes where the settings ask for them."""
    upright, turned = _cells(nodes, settings, scope)
    radius = lambda name: min(nearest, max(getattr(s, name) for s in settings))
    near = near_hashes if comps is None else meeting_others
    cells, second = _homes(upright, comps), _dhash_radius(settings)
    grows = lambda name: radius(name) > done
    found = []
    if not grows("same_format_radius"):
        pass
    elif second is not None and second < 8:
        twice = upright.join(nodes.select("node_id", "dhash"), "node_id").select("cell", "dhash").distinct()
        twice = twice.join(cells, "cell") if comps is not None else twice
        found.append(near_hashes(twice, twice, radius("same_format_radius"), [0, 1], True, at_most, second))
    else:
        found.append(near(cells, cells, radius("same_format_radius"), [0, 1], True, at_most))
    if grows("rotation_radius"):
        found.append(near(
            _homes(turned, comps), cells, radius("rotation_radius"), [-1, 0, 1], False,
            3 * at_most if at_most else None,
        ))
    formats = nodes.agg(F.max("is_raw"), F.min("is_raw")).first()
    if grows("cross_format_radius") and formats[0] and not formats[1]:
        side = lambda flag: cells.filter(F.col("cell.cls").endswith(flag)).withColumn("cell", _as_class("cell", flag, "x"))
        cross = near(side("true"), side("false"), radius("cross_format_radius"), [-1, 0, 1], False, at_most)
        found.append(cross.select(_as_class("u", "x", "true").alias("u"), _as_class("v", "x", "false").alias("v")))
    return upright.union(turned), reduce(DataFrame.union, found)


def _linker(nodes: DataFrame, settings: list[Settings], grid: DataFrame | None) -> Linker:
    params = Params(settings[0], "cfg" if grid is not None else None)
    first = settings[0]
    return Linker(
        nodes.select("node_id", *PAIR_COLUMNS),
        lambda a, b: PairRule(a, b, params).similar,
        grid, len(settings) if grid is not None else 1,
        _dhash_radius(settings), first.low_entropy, first.low_entropy_dhash - 1,
        lambda a, b: PairRule(a, b, params).similar_but_histogram, ("histogram",),
    )


def pair_linker(nodes: DataFrame, settings: Settings) -> Linker:
    """Tests pairs of nodes by the rule of one configuration."""
    return _linker(nodes, [settings], None)


def _alone(nodes: DataFrame, params: Params, grid: DataFrame | None) -> DataFrame:
    """Nodes with copies that pass the rule against themselves; only an unnormalised histogram fails."""
    df = nodes.filter("copies > 1")
    df = df.crossJoin(F.broadcast(grid)) if grid is not None else df.withColumn("combo_id", F.lit(0))
    r = F.struct(*PAIR_COLUMNS)
    return df.filter(PairRule(r, r, params).similar).select("node_id", "combo_id")


def _grown(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    return materialise(connected_components(edges), "components") if comps is None else extend_components(comps, edges)


def similarity_components(features: DataFrame, settings: Settings) -> DataFrame:
    """``(image_id, component)`` for every image that is linked to another one.

    Near hashes in dense places make pairs with the square of the files, nearly all of them inside one component. So the
    nearest cells are linked first, and of the others only those that are not within one component by then. Tables of
    middle size are compared in blocks: these need few and small plans, where the stages fill the driver with theirs.
    """
    nodes, membership = collapse(features, PAIR_COLUMNS)
    n = nodes.count()
    wide = max(settings.same_format_radius, settings.cross_format_radius) > STAGES[-1]
    if BLOCKED[0] < n <= (BLOCKED[1] if wide else MOST_BLOCKED):
        comps = _by_blocks(nodes, [settings])
    else:
        comps = _in_stages(nodes, n, settings)
    comps = _named_components(nodes, comps, 1, _alone(nodes, Params(settings), None))
    return membership.join(comps, "node_id").select("image_id", "component")


def _in_stages(nodes: DataFrame, n: int, settings: Settings) -> DataFrame:
    linker = _linker(nodes, [settings], None)
    comps, done = None, -1
    widest = max(settings.same_format_radius, settings.rotation_radius, settings.cross_format_radius)
    stages = [r for r in STAGES if r < widest] if n > STAGED else []
    for nearest in [*stages, widest]:
        members, pairs = pair_cells(nodes, [settings], nearest=nearest, done=done, comps=comps)
        done = nearest
        comps = _grown(comps, linker.link(members, pairs, comps))
    return comps


def similarity_components_grid(features: DataFrame, settings: list[Settings], scope: str | None = None) -> DataFrame:
    """``(combo_id, image_id, component)`` under every configuration, from one pass over the candidates. Rows of
    different values in the column ``scope`` are never linked.

    ``combo_id`` is the position in ``settings``. Only values in ``PAIR_FIELDS`` may differ between them.

    Configurations that differ in the threshold alone are one family: a pair that passes under some threshold passes
    under every larger one, so one test finds the first threshold it passes under. Wide thresholds leave no selective
    key, so nodes meet in blocks.
    """
    nodes, membership = collapse(features, [*([scope] if scope else []), *PAIR_COLUMNS])
    comps = _by_blocks(nodes, settings, scope)
    grid = settings_grid(features.sparkSession, settings)
    comps = _named_components(nodes, comps, len(settings), _alone(nodes, Params(settings[0], "cfg"), grid))
    return membership.join(comps, "node_id").select("combo_id", "image_id", "component")


def _by_blocks(nodes: DataFrame, settings: list[Settings], scope: str | None = None) -> DataFrame:
    """``(node, component)`` of vertices (node and configuration): the nearest nodes are linked first, and of all
    pairs that blocks of nodes make only those that are not within one component by then, under some configuration."""
    shaped = nodes.withColumn("bin", shape_bin(settings))
    edges_of, n, comps = _graded(nodes, settings), nodes.count(), None
    for nearest in (True, False) if n > NEAREST_FIRST else (False,):
        ids = materialise(near_nodes(shaped, n, settings, scope, nearest, comps), "met")
        comps = _grown(comps, materialise(edges_of(ids.distinct() if nearest else ids), "links"))
    return comps


def _graded(nodes: DataFrame, settings: list[Settings]) -> Callable[[DataFrame], DataFrame]:
    """What makes node pairs ``(a, b)`` the edges ``(src, dst)`` of vertices under every configuration.

    A pair is tested once for each family of configurations that differ in the threshold alone: the first threshold it
    passes under tells the others."""
    if len(settings) == 1:
        return _linker(nodes, settings, None).test
    spark = nodes.sparkSession
    others = [f for f in PAIR_FIELDS if f != "threshold"]
    key = lambda s: tuple(getattr(s, f) for f in others)
    families: dict[tuple, list[int]] = {}
    for s in settings:
        families.setdefault(key(s), []).append(s.threshold)
    levels = {k: sorted(set(found)) for k, found in families.items()}
    number = {k: i for i, k in enumerate(levels)}
    widest = [next(s for s in settings if key(s) == k).with_(threshold=found[-1]) for k, found in levels.items()]
    steps = spark.createDataFrame([(number[k], found) for k, found in levels.items()], "combo_id int, levels array<int>")
    linker = _linker(nodes, widest, settings_grid(spark, widest).join(F.broadcast(steps), "combo_id"))
    params = Params(settings[0], "cfg")

    def weight(a: Column, b: Column) -> Column:
        def fails(threshold: Column) -> Column:
            rule = PairRule(a, b, AtThreshold(params, threshold))
            return ~(rule.phash_ok & rule.dhash_ok)

        return F.size(F.filter("levels", fails))

    # One row per configuration: the family it belongs to and its threshold's place there.
    cuts = spark.createDataFrame(
        [(number[key(s)], levels[key(s)].index(s.threshold), i) for i, s in enumerate(settings)], "family int, cut int, combo_id int")
    n, combos = len(levels), len(settings)
    vertex = lambda end: F.expr(f"({end} div {n}) * {combos} + combo_id").alias(end)

    def edges_of(ids: DataFrame) -> DataFrame:
        own = linker.test(ids, weight).withColumn("family", F.pmod("src", F.lit(n)).cast("int"))
        return own.join(F.broadcast(cuts), "family").filter("weight <= cut").select(vertex("src"), vertex("dst"))

    return edges_of


def borderline_components(features: DataFrame, settings: Settings) -> DataFrame:
    """Components of pairs just beyond the threshold, over the images given."""
    columns = ["width", "height", "brightness", "phash"]
    nodes, membership = collapse(features, columns)
    shaped = nodes.withColumn(
        "bin", ratio_bin(shape_log(F.struct("width", "height"), turned=False), settings.ar_tolerance_pct)
    )
    members = shaped.select("node_id", cell("B", F.lit(""), F.col("bin"), F.col("phash")).alias("cell"))
    radius = int(settings.threshold * settings.ambiguous_threshold_factor)
    params = Params(settings)
    linker = Linker(nodes.select("node_id", *columns), lambda a, b: borderline_pair(a, b, params))
    comps = None
    for one_in in (FIRST_PART, 1) if nodes.count() > STAGED else (1,):
        cells = _homes(members, comps)
        pairs = near_hashes(cells, cells, radius, [0, 1], True, beyond=settings.threshold, one_in=one_in)
        # Equal hashes are never borderline.
        comps = _grown(comps, linker.link(members, pairs, comps, within=False))
    comps = _named_components(nodes, comps, 1)
    return membership.join(comps, "node_id").select("image_id", "component")
