"""Which member of a group is kept and which is a removable copy.

Everything is a minimum, a count or a sum per key, joined back to the members; no group is ever gathered in one
task, and no step lists the pairs of a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.config import Params, Settings
from twinframe.functions.hashing import ROTATIONS, hamming, rotation_distance
from twinframe.operators.components import connected_components
from twinframe.operators.predicates import PairRule, preview_of, relative_gap, trunc
from twinframe.operators.ranking import bit_total_sql, bit_totals, group_medoids, keep_order
from twinframe.operators.similarity import PAIR_COLUMNS
from twinframe.session import materialise

TASK_PAIRS = 5_000_000


def close_set_limit(radius: int) -> int:
    """How many different words of 64 bits can be pairwise within ``radius`` bits (Kleitman 1966)."""
    half, odd = divmod(min(radius, 64), 2)
    return (1 + odd) * sum(math.comb(64 - odd, i) for i in range(half + 1))


def size_buckets(members: DataFrame, same_format: bool, tolerance_pct: float, p: Params) -> DataFrame:
    """``(group_id, lo, hi, is_raw, bucket)`` for sizes that are linked to another size of their group.

    Works on the distinct sizes of a group. RAW against other formats tolerates 2 %; with ``same_format`` equal
    formats are linked too, within the series tolerance. Turned sizes count as the same.

    Sizes are dealt into the cells of a grid over the logarithms of both sides, as wide as the tolerance, so sizes that
    are near lie in one cell or in cells at most two apart. Sizes of one format in one cell are all near and linked to the
    first of them; two cells are linked if their nearest sizes are, looked for among the outermost height of each width.
    """
    sizes = members.filter("lo > 0").groupBy("group_id", "lo", "hi", "is_raw").agg(F.first("cfg").alias("cfg"))
    sizes = sizes.withColumn("id", F.monotonically_increasing_id())
    tol = F.col("cfg.series_tolerance_pct") / 100.0 if p.grid_column else F.lit(p.settings.series_tolerance_pct / 100)
    sizes = materialise(sizes.withColumn("tol", tol.cast("double")).drop("cfg"), "sizes")
    cross = F.lit(p.settings.cross_size_tolerance)
    raw, other = sizes.filter("is_raw"), sizes.filter("not is_raw")
    crossed = F.greatest("tol", cross) if same_format else cross
    edges = _near_sizes(raw.withColumn("tol", crossed), other.withColumn("tol", crossed))
    if same_format and tolerance_pct > 0:
        edges = edges.union(_near_of_one_format(sizes.filter("tol > 0")))
    comps = connected_components(edges)
    linked = sizes.join(comps, sizes["id"] == comps["node"])
    return linked.select("group_id", "lo", "hi", "is_raw", F.col("component").cast("string").alias("bucket"))


def _on_grid(sizes: DataFrame) -> DataFrame:
    """Sizes with their cell ``x, y``; the cells are a little narrower than the tolerance ``tol``."""
    step = F.greatest(-F.ln(1.0 - F.least("tol", F.lit(0.99))) * (1 - 1e-9), F.lit(1e-9))
    cell = lambda side: F.floor(F.ln(F.col(side).cast("double")) / step).cast("long")
    return sizes.withColumns({"x": cell("lo"), "y": cell("hi")})


def _around(df: DataFrame, least_x: int) -> DataFrame:
    """Each row once for every cell at most two away to look into."""
    shifts = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(least_x, 3) for y in range(-2, 3)]
    return df.withColumn("d", F.explode(F.array(*shifts))).withColumns({"x": F.col("x") + F.col("d.x"), "y": F.col("y") + F.col("d.y")}).drop("d")


def _within(a: str, b: str) -> Column:
    gap = F.greatest(relative_gap(F.col(f"{a}.lo"), F.col(f"{b}.lo")), relative_gap(F.col(f"{a}.hi"), F.col(f"{b}.hi")))
    return gap <= F.col(f"{a}.tol")


def _near_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(src, dst)``: sizes of two formats within the tolerance, found in neighbouring cells."""
    a, b = _around(_on_grid(left), -2).alias("a"), _on_grid(right).alias("b")
    on = F.col("a.group_id") == F.col("b.group_id")
    for c in ("x", "y"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on & _within("a", "b")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def _near_of_one_format(sizes: DataFrame) -> DataFrame:
    """``(src, dst)`` that connect what the sizes of one format within the tolerance connect."""
    cell = ["group_id", "is_raw", "x", "y"]
    placed = materialise(_on_grid(sizes), "grid")
    firsts = placed.groupBy(*cell).agg(F.min("id").alias("first"))
    inside = placed.join(firsts, cell).filter("id <> first").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    # Of one width the lowest and the highest size: between cells one above the other no other is nearer.
    edge = placed.groupBy(*cell, "lo", "tol").agg(F.min(F.struct("hi", "id")).alias("low"), F.max(F.struct("hi", "id")).alias("high"))
    edge = edge.select(*cell, "lo", "tol", F.explode(F.array_distinct(F.array("low", "high"))).alias("e")).select(
        *cell, "lo", "tol", F.col("e.hi").alias("hi"), F.col("e.id").alias("id"))
    a, b = _around(edge, 0).alias("a"), edge.alias("b")
    on = _within("a", "b") & (F.col("a.id") != F.col("b.id"))
    for c in cell:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    between = a.join(b, on).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    return inside.union(between)


def _struct(name: str, columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns]).alias(name)


def _close_buckets(rows: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    """Per bucket: ``exact`` when no two upright hashes are further apart than the exact radius."""
    hashes = rows.select(*key, "phash").distinct()
    stats = rows.groupBy(*key).agg(
        F.max(hamming(F.col("phash"), F.col("first.phash"))).alias("reach")
    ).join(hashes.groupBy(*key).agg(F.count(F.lit(1)).alias("hashes")), key)
    maybe = stats.filter((F.col("reach") <= settings.exact_radius) & (F.col("hashes") <= close_set_limit(settings.exact_radius)))
    some = hashes.join(maybe.filter("hashes > 2").select(*key), key)
    firsts = rows.select(*key, F.col("first.phash").alias("start")).distinct()
    some = some.join(firsts, key).select(*key, F.struct("phash").alias("me"), "start", F.lit(settings.exact_radius).alias("limit"))
    upright = lambda a, b: hamming(a["phash"], b["phash"])
    return maybe.join(_far_apart(some, key, ["phash"], upright), key, "left_anti").select(*key)


def _turned_buckets(rows: DataFrame, key: list[str], p: Params) -> DataFrame:
    """Per bucket: every pair is the same picture in some orientation.

    Most buckets are ruled out by their distances to the first member, then to the member furthest from it; in buckets
    that pass both, only hash sets near the rim are compared.
    """
    limit = trunc(F.lit(p.settings.rotation_base) * p.rotation_threshold_factor)
    hash_columns = ["phash", *ROTATIONS]
    sets = rows.groupBy(*key, *hash_columns).agg(F.first("first").alias("first"), F.first("cfg").alias("cfg"))
    sets = sets.withColumn("me", F.struct(*hash_columns)).withColumn("limit", limit)
    sets = materialise(sets.select(*key, "me", "first", "limit"), "turned")
    far = F.max(F.struct(rotation_distance(F.col("me"), F.col("first")).alias("d"), F.col("me").alias("who")))
    step = sets.groupBy(*key).agg(far.alias("far"), F.count(F.lit(1)).alias("sets"), F.first("limit").alias("limit"))
    step = step.filter("far.d <= limit")
    second = sets.drop("limit").join(step, key).groupBy(*key).agg(
        F.max(rotation_distance(F.col("me"), F.col("far.who"))).alias("d"), F.first("sets").alias("sets"),
        F.first("limit").alias("limit"),
    ).filter("d <= limit")
    second = materialise(second, "within")
    many = sets.join(second.filter("sets > 2").select(*key), key).select(*key, "me", F.col("first.phash").alias("start"), "limit")
    return second.select(*key).join(_far_apart(many, key, hash_columns, rotation_distance), key, "left_anti")


def _far_apart(sets: DataFrame, key: list[str], hashes: list[str], distance) -> DataFrame:
    """The keys of ``sets (key, me, start, limit)`` with two hash sets further apart than the limit.

    The hashes of a bucket lie around a few centres, one for each orientation of its first member ``start``; the bitwise
    majority of the hashes turned alike is taken for each. For any word ``q`` two sets are within the limit if the upright
    distance of one to ``q`` and the distance of some orientation of the other to ``q`` sum up to it, as Hamming
    distances obey the triangle inequality. A set that is near enough to a centre for all others of its bucket drops
    out. What is left, the rim, meets by classes of equal distances to the centres, and only classes that no centre
    settles are compared, in squares of blocks.
    """
    turns = F.array(*[F.col(f"me.{h}") for h in hashes])
    known = F.filter(F.transform(turns, lambda h, i: F.struct(hamming(h, F.col("start")).alias("d"), i.alias("turn"))), lambda x: x["d"].isNotNull())
    nearest = F.array_min(known)
    turned = sets.withColumn("turn", nearest["turn"])
    bits = turned.groupBy(*key, "turn").agg(F.count(F.lit(1)).alias("n"), *bit_totals(F.col("me.phash")))
    majority = F.expr(" | ".join(f"if({bit_total_sql(k)} * 2 > n, shiftleft(1L, {k}), 0L)" for k in range(64)))
    # At most one centre per orientation.
    centres = bits.select(*key, majority.alias("centre")).groupBy(*key).agg(F.collect_set("centre").alias("centres"))
    to = lambda h, q: F.bit_count(h.bitwiseXOR(q))
    cap = lambda d: F.least(d, F.col("limit") + 1)
    placed = sets.join(centres, key).select(
        *key, "me", "limit",
        F.transform("centres", lambda q: cap(to(F.col("me.phash"), q))).alias("up"),
        F.transform("centres", lambda q: cap(F.array_min(F.array(*[to(F.col(f"me.{h}"), q) for h in hashes])))).alias("any"))
    places = range(len(hashes))
    most = placed.groupBy(*key).agg(*[
        F.max(F.get(name, F.lit(i))).alias(f"{name}{i}") for name in ("up", "any") for i in places])
    near = [(F.get("up", F.lit(i)) + F.col(f"any{i}") <= F.col("limit")) | (F.get("any", F.lit(i)) + F.col(f"up{i}") <= F.col("limit")) for i in places]
    safe = F.coalesce(near[0], F.lit(False))
    for other in near[1:]:
        safe = safe | F.coalesce(other, F.lit(False))
    rim = materialise(placed.join(most, key).filter(~safe).select(*key, "me", "limit", F.struct("up", "any").alias("place")), "rim")
    classes = rim.groupBy(*key, "place").agg(F.count(F.lit(1)).alias("n"), F.first("limit").alias("limit"))
    a, b = classes.alias("a"), classes.alias("b")
    same = F.col("a.place") <= F.col("b.place")
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    sums = lambda x, y: F.exists(F.zip_with(F.col(x), F.col(y), lambda u, v: u + v), lambda d: d <= F.col("a.limit"))
    settled = sums("a.place.up", "b.place.any") | sums("a.place.any", "b.place.up")
    side = F.ceil(F.sqrt(F.col("a.n") * F.col("b.n") / TASK_PAIRS)).cast("int")
    meets = a.join(b, same).filter(~settled).select(
        *[F.col(f"a.{k}").alias(k) for k in key], F.col("a.place").alias("pa"), F.col("b.place").alias("pb"), side.alias("side"))
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    lhs = rim.withColumnsRenamed({"place": "pa", "me": "x"}).join(meets, [*key, "pa"])
    lhs = lhs.withColumn("row_block", F.pmod(F.xxhash64("x"), F.col("side")).cast("int")).withColumn("column_block", every).drop("side")
    rhs = rim.select(*key, F.col("place").alias("pb"), F.col("me").alias("y")).join(meets, [*key, "pb"])
    rhs = rhs.withColumn("column_block", F.pmod(F.xxhash64("y"), F.col("side")).cast("int")).withColumn("row_block", every).drop("side")
    on = [*key, "pa", "pb", "row_block", "column_block"]
    return lhs.join(rhs, on).filter(distance(F.col("x"), F.col("y")) > F.col("limit")).select(*key).distinct()


def _series(rows: DataFrame, features: DataFrame, key: list[str], p: Params) -> DataFrame:
    """Members of burst buckets that belong to the series around the bucket's medoid."""
    medoids = group_medoids(rows.select(*key, "image_id", "phash", "k"), key, F.col("k"))
    wide = features.select("image_id", _struct("f", PAIR_COLUMNS))
    centre = medoids.join(wide.withColumnsRenamed({"image_id": "medoid", "f": "m"}), "medoid")
    near = rows.join(centre, key).join(wide, "image_id")
    limit = trunc(p.threshold * p.series_threshold_factor)
    close = rotation_distance(F.col("m"), F.col("f"), both_ways=False) <= limit
    near = near.filter(close & PairRule(F.col("m"), F.col("f"), p).similar).select(*key, "image_id")
    enough = near.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    return near.join(enough, key).select("group_id", "image_id")


def classify(groups: DataFrame, features: DataFrame, settings: Settings, grid: DataFrame | None = None,
             tolerance_pct: float | None = None) -> DataFrame:
    """``(group_id, image_id, role, is_series, is_ambiguous, in_series)`` for every group with something to remove.

    With ``grid``, ``groups`` also has a ``combo_id`` and ``group_id`` is unique across configurations.
    """
    p = Params(settings, "cfg" if grid is not None else None)
    tolerance_pct = settings.series_tolerance_pct if tolerance_pct is None else tolerance_pct
    columns = ["image_id", "name", "ext", "is_raw", "width", "height", "file_size", "mtime", "exif_date",
               "phash", *ROTATIONS]
    m = groups.join(features.select(*columns), "image_id")
    m = m.join(F.broadcast(grid), "combo_id") if grid is not None else m.withColumn("cfg", F.lit(None).cast("string"))
    m = m.withColumns({
        "k": keep_order(settings), "lo": F.least("width", "height"), "hi": F.greatest("width", "height"),
    }).drop("name", "mtime", "exif_date", "file_size")
    m = materialise(m, "members")

    tops = m.groupBy("group_id").agg(
        F.min(F.struct("k", "image_id", "width", "height", "is_raw")).alias("best"),
        F.max("is_raw").alias("some_raw"), F.min("is_raw").alias("all_raw"),
    )
    mixed = m.join(tops.filter("some_raw and not all_raw").select("group_id"), "group_id", "left_semi")
    size_key = ["group_id", "lo", "hi", "is_raw"]
    cross = size_buckets(mixed, False, tolerance_pct, p)
    m = m.join(cross, size_key, "left").withColumnRenamed("bucket", "cross_bucket")

    # Mixed formats: the best copy of each extension stays, further copies go.
    ext_best = m.filter("cross_bucket is not null").groupBy("group_id", "cross_bucket", "ext").agg(
        F.min("k").alias("ext_first")
    )
    m = m.join(ext_best, ["group_id", "cross_bucket", "ext"], "left")
    in_cross, is_first = F.col("cross_bucket").isNotNull(), F.col("k") == F.col("ext_first")
    kept_format = F.lit(True) if settings.keep_all_formats else F.col("is_raw")
    m = m.withColumns({
        "cross_series": F.coalesce(in_cross & is_first & kept_format, F.lit(False)),
        "cross_dup": F.coalesce(in_cross & ~(is_first & kept_format), F.lit(False)),
    }).drop("ext_first")

    # One format: exact copies, turned copies, or a burst.
    if tolerance_pct > 0:
        buckets = size_buckets(m, True, tolerance_pct, p)
        m = m.join(buckets, size_key, "left")
    else:
        m = m.withColumn("bucket", F.col("cross_bucket"))
    alone = F.when(F.col("lo") > 0, F.concat_ws("x", "lo", "hi", F.col("is_raw").cast("string")))
    m = materialise(m.withColumn("bucket", F.coalesce("bucket", alone)), "bucketed")
    key = ["group_id", "bucket"]
    firsts = m.filter("bucket is not null").groupBy(*key).agg(
        F.min(F.struct("k", "phash", *ROTATIONS)).alias("first"), F.count(F.lit(1)).alias("n"),
        F.max("is_raw").alias("some_raw"), F.min("is_raw").alias("all_raw"),
    )
    rows = m.join(firsts.filter("n > 1 and some_raw = all_raw").select(*key, "first"), key)
    rows = materialise(rows.filter(~p.disable_series_detection), "rows")
    exact = materialise(_close_buckets(rows, key, settings), "exact")
    others = rows.join(exact, key, "left_anti")
    turned = materialise(_turned_buckets(others, key, p), "turnedkeys")
    copies = rows.join(exact.union(turned), key, "left_semi").filter(F.col("k") != F.col("first.k"))
    copies = copies.select("group_id", "image_id", F.lit("copy").alias("mark"))
    series = _series(others.join(turned, key, "left_anti"), features, key, p)
    marks = materialise(copies.union(series.withColumn("mark", F.lit("series"))), "marks")

    m = m.join(marks, ["group_id", "image_id"], "left").join(tops.select("group_id", "best"), "group_id")
    m = m.withColumns({
        "dup": F.col("cross_dup") | F.coalesce(F.col("mark") == "copy", F.lit(False)),
        "series": F.col("cross_series") | F.coalesce(F.col("mark") == "series", F.lit(False)),
        "me": F.struct("image_id", "width", "height", "is_raw"),
    })
    smaller = preview_of(F.col("me"), F.col("best"), p)
    if settings.keep_all_formats:
        open_ = ~F.col("dup") & ~F.col("series")
        leads = m.filter(open_).groupBy("group_id", "ext").agg(F.min(F.struct("k", "phash")).alias("lead"))
        m = m.join(leads, ["group_id", "ext"], "left")
        tol = F.when(
            F.col("is_raw") != F.col("best.is_raw"),
            F.greatest(p.series_tolerance_pct / 100.0, F.lit(settings.cross_size_tolerance)),
        ).otherwise(p.series_tolerance_pct / 100.0)
        full = (F.col("best.width") > 0) & (F.col("best.height") > 0)
        full = full & F.when(full, (relative_gap(F.col("width"), F.col("best.width")) <= tol)
                             & (relative_gap(F.col("height"), F.col("best.height")) <= tol)).otherwise(F.lit(False))
        same = (F.col("width") == F.col("best.width")) & (F.col("height") == F.col("best.height"))
        other_shot = same & (hamming(F.col("phash"), F.col("lead.phash")) > settings.exact_radius)
        is_lead = F.col("k") == F.col("lead.k")
        free = F.when(is_lead, ~full & smaller).otherwise(smaller & ~other_shot)
    else:
        free = smaller
    preview = F.when(F.col("dup"), F.lit(True)).when(F.col("series"), F.lit(False)).otherwise(free)
    m = m.withColumn("role", F.when(preview, "preview").otherwise("original"))
    keep = ["group_id", "image_id", "role", "series", "cross_bucket"] + (["combo_id"] if grid is not None else [])
    m = materialise(m.select(*keep), "roles")
    flags = m.groupBy("group_id").agg(
        F.max(F.col("series") | F.col("cross_bucket").isNotNull()).alias("is_series"),
        F.count_if(F.col("role") == "preview").alias("previews"),
    ).filter("previews > 0")
    extra = ["combo_id"] if grid is not None else []
    return m.join(flags, "group_id").select(
        "group_id", "image_id", "role", "is_series", F.lit(False).alias("is_ambiguous"),
        F.col("series").alias("in_series"), *extra,
    )
