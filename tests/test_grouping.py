import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.operators import candidates, links, split
from twinframe.operators.components import connected_components
from twinframe.operators.forest import minimum_spanning_forest
from twinframe.operators.similarity import borderline_components, similarity_components, similarity_components_grid
from twinframe.operators.split import split_oversized

from builders import FLAT, NARROW, components, frame, ham, random_rows, row, signed, similar


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 8, 10, 12, 20])
@pytest.mark.parametrize("n", [100, 10**6, 10**10])
def test_masks_never_miss(radius, n):
    masks = candidates.plan_masks(radius, 2 * n, n * n)
    assert len(masks) <= candidates.MAX_MASKS
    rng = random.Random(radius)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(signed(diff) & m == 0 for m in masks)


def test_wider_tables_get_longer_keys():
    bits = [min(bin(m & (2**64 - 1)).count("1") for m in candidates.plan_masks(2, 2 * n, n * n)) for n in (10**3, 10**6, 10**10)]
    assert bits[0] <= bits[1] < bits[2]


@pytest.mark.parametrize("radius,shared", [(2, 40), (2, 60), (9, 40)])
def test_half_of_all_hashes_on_one_band(spark, monkeypatch, radius, shared):
    """Crowded keys are refined or cut into blocks: no key has many more pairs than stated, and no pair is lost."""
    monkeypatch.setattr(candidates, "KEY_PAIRS", 400)
    monkeypatch.setattr(candidates, "COUNTED", 1)
    rng = random.Random(shared)
    hashes = {rng.getrandbits(64 - shared) << shared for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    for h in rng.sample(sorted(hashes), 60):
        for b in rng.sample(range(64), rng.randint(1, radius)):
            h ^= 1 << b
        hashes.add(h)
    hashes = [signed(h) for h in hashes]
    kind = "cell struct<kind:string,cls:string,bin:long,hash:long>"
    cells = spark.createDataFrame([(("U", "a", 3, h),) for h in hashes], kind)
    got = {tuple(sorted((r.u.hash, r.v.hash))) for r in candidates.near_hashes(cells, cells, radius, [0, 1], True).collect()}
    found = candidates.near_hashes(cells, cells, radius, [0, 1], True).count()
    assert got == {tuple(sorted(p)) for p in combinations(hashes, 2) if ham(*p) <= radius} and found == len(got)
    masks = candidates.plan_masks(radius, 2 * len(hashes), len(hashes) ** 2)
    if masks == [0]:
        masks = candidates.masks_for(radius, 1, radius + 2)
    lhs, rhs, on = candidates._dealt(cells, cells, radius, [0], masks, 1e9)
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    assert count(lhs, "l").join(count(rhs, "r"), on).agg(F.max(F.col("l") * F.col("r"))).first()[0] <= 4 * 400


def _plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("name", ["chain", "star", "clique", "random", "empty"])
def test_components(spark, name):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(50)],
        "clique": list(combinations(range(100, 112), 2)),
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(110)], "empty": [],
    }[name]
    edges = [(a, b) for a, b in edges if a != b]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r[0]: r[1] for r in got.collect()} == _plain_components(edges)


def _found(df):
    return {r["image_id"]: r["component"] for r in df.collect()}


def _force_cell_rounds(monkeypatch):
    """Take the way of crowded cells, whatever the size."""
    monkeypatch.setattr(links, "REST_PER_NODE", 0)
    monkeypatch.setattr(links, "SMALL_CELL", 0)
    monkeypatch.setattr(links, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(links, "TASK_PAIRS", 50)


@pytest.mark.parametrize("s,crowded", [
    (Settings(low_entropy=4.4), True),
    (Settings(threshold=5, raw_use_embedded_thumb=False, ar_tolerance_pct=0.0, use_histogram=False), False),
])
def test_components_equal_all_pairs(spark, monkeypatch, s, crowded):
    if crowded:
        _force_cell_rounds(monkeypatch)
    rows = random_rows(160, seed=11, centres=9)
    rows += [{**r, "image_id": r["image_id"].replace("/d/", "/e/")} for r in rows[:30]]
    want = components(rows, s)
    assert _found(similarity_components(frame(spark, rows), s)) == want
    assert len(set(want.values())) > 3


def test_one_hash_holding_most_rows(spark, monkeypatch):
    """Blank pictures share a hash but differ in the second one; the answer is that of all pairs."""
    _force_cell_rounds(monkeypatch)
    rng = random.Random(5)
    blank = [row(f"/b/{i:04d}.jpg", 0, rng.getrandbits(6), hist=NARROW, brightness=rng.choice([50.0, 90.0, 200.0]))
             for i in range(120)]
    near = [row(f"/n/{i:04d}.jpg", 1 << rng.randrange(64), rng.getrandbits(2), hist=rng.choice([NARROW, FLAT]))
            for i in range(40)]
    rows = blank + near + [row("/u/1.jpg", 0, 0xFFFF, hist=FLAT), row("/u/2.jpg", 0, 0, hist=FLAT)]
    s = Settings(use_histogram=False, threshold=3)
    assert _found(similarity_components(frame(spark, rows), s)) == components(rows, s)


def test_copies_with_a_histogram_unlike_itself(spark):
    thin = [0.1] * 96  # does not sum to one per channel, so a row does not match itself
    rows = [row(f"/a/{i}.jpg", 7, hist=[0.001] * 96) for i in range(3)] + [row(f"/b/{i}.jpg", 99, hist=thin) for i in range(2)]
    assert _found(similarity_components(frame(spark, rows), Settings())) == components(rows, Settings())


def test_grid_equals_single_runs(spark):
    rows = random_rows(90, seed=2, centres=5)
    combos = [Settings(), Settings(threshold=6, use_histogram=False), Settings(threshold=4, use_dual_hash=False)]
    got = similarity_components_grid(frame(spark, rows), combos).collect()
    for i, s in enumerate(combos):
        assert {r["image_id"]: r["component"] for r in got if r["combo_id"] == i} == components(rows, s)


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_keeps_the_components_of_every_limit(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80), rng.randrange(6)) for _ in range(150 if seed == 1 else 600)]
    edges += edges[:20] + [(3, 3, 0)] + [(900 + i, 900, 2) for i in range(40)]
    table = spark.createDataFrame(edges, "src long, dst long, weight int")
    forest = [tuple(r) for r in minimum_spanning_forest(table).collect()]
    assert set(forest) <= {(min(a, b), max(a, b), w) for a, b, w in edges}
    for limit in range(6):
        kept = lambda es: {x: c for x, c in _plain_components([(a, b) for a, b, w in es if w <= limit and a != b]).items()}  # noqa: B023
        assert kept(forest) == kept(edges)
    assert len(forest) == len(_plain_components([(a, b) for a, b, _ in forest])) - len(set(_plain_components([(a, b) for a, b, _ in forest]).values()))
    assert minimum_spanning_forest(table.limit(0)).collect() == []


@pytest.mark.parametrize("crowded", [False, True])
def test_grid_of_thresholds_equals_single_runs(spark, monkeypatch, crowded):
    """Thresholds are cuts of one forest per family of settings; the way of crowded cells gives the same."""
    if crowded:
        _force_cell_rounds(monkeypatch)
    else:
        monkeypatch.setattr(links, "REST_PER_NODE", 10**9)
    rows = random_rows(90, seed=8, centres=5)
    combos = [Settings(threshold=t, low_entropy=4.4, **more) for t in (1, 4, 9) for more in ({}, {"use_histogram": False})]
    got = similarity_components_grid(frame(spark, rows), combos).collect()
    for i, s in enumerate(combos):
        assert {r["image_id"]: r["component"] for r in got if r["combo_id"] == i} == components(rows, s)


def test_borderline(spark):
    s = Settings(threshold=2, ambiguous_threshold_factor=2.5)

    def edge(a, b, s):
        ra, rb = (x["width"] / x["height"] if x["height"] else 1.0 for x in (a, b))
        return (abs(ra - rb) / max(ra, rb, 0.001) <= 0.05 and abs(a["brightness"] - b["brightness"]) <= 60
                and 2 < ham(a["phash"], b["phash"]) <= 5)

    rows = random_rows(120, seed=4, centres=8)
    assert _found(borderline_components(frame(spark, rows), s)) == components(rows, s, edge)


# Splitting ----------------------------------------------------------------------------------------

def _split_plain(rows, s):
    """One bucket, one centre after the other, in the order of total distance and id."""
    if s.max_group_size <= 0 or len(rows) <= s.max_group_size:
        return [[r["image_id"] for r in rows]]
    total = {r["image_id"]: sum(ham(r["phash"], o["phash"]) for o in rows) for r in rows}
    bucket, out = sorted(rows, key=lambda r: (total[r["image_id"]], r["image_id"])), []
    while len(bucket) > s.max_group_size:
        kept = [r for r in bucket if r is bucket[0] or similar(bucket[0], r, s)]
        out.append([r["image_id"] for r in kept])
        bucket = [r for r in bucket if r not in kept]
    return [g for g in [*out, [r["image_id"] for r in bucket]] if len(g) > 1]


def _split(spark, rows, s):
    comps = spark.createDataFrame([(r["image_id"], "c") for r in rows], "image_id string, component string")
    got = {}
    for r in split_oversized(comps, frame(spark, rows), s).collect():
        got.setdefault(r["group_id"], set()).add(r["image_id"])
    alone = got.pop(None, set())
    assert len(alone) + sum(map(len, got.values())) == len(rows)
    return sorted(map(sorted, got.values()))


CAP = Settings(max_group_size=10, use_histogram=False)


def test_split_cases(spark):
    same = [row(f"/s/{i:03d}.jpg") for i in range(5)]
    star = [row("/s/000.jpg")] + [row(f"/s/{i:03d}.jpg", 1 << i) for i in range(1, 20)]
    chain = [row(f"/s/{i:03d}.jpg", (1 << i) - 1) for i in range(20)]
    assert _split(spark, same, CAP) == [[r["image_id"] for r in same]]
    assert len(_split(spark, star, CAP)) == 1
    assert all(len(g) < 20 for g in _split(spark, chain, CAP))
    assert len(_split(spark, [row(f"/s/{i:03d}.jpg") for i in range(100)], CAP.with_(max_group_size=0))) == 1


@pytest.mark.parametrize("leaders", [1, 64])
def test_split_equals_one_by_one(spark, monkeypatch, leaders):
    monkeypatch.setattr(split, "FIRST_STEP", leaders)
    monkeypatch.setattr(split, "STEP_FACTOR", 2 if leaders == 1 else 8)
    s = Settings(max_group_size=8, threshold=4, low_entropy=4.4)
    rows = random_rows(60 if leaders == 1 else 230, seed=3, centres=6)
    assert _split(spark, rows, s) == sorted(map(sorted, _split_plain(rows, s)))


def test_split_of_a_component_does_not_depend_on_others(spark):
    one, two = random_rows(40, seed=5, centres=4), random_rows(90, seed=6, centres=4)
    one, two = ([{**r, "image_id": f"/{k}{r['image_id']}"} for r in rows] for k, rows in (("a", one), ("b", two)))
    s = Settings(max_group_size=8, threshold=4, low_entropy=4.4)
    comps = spark.createDataFrame(
        [(r["image_id"], r["image_id"][:2]) for r in one + two], "image_id string, component string")
    got = {}
    for r in split_oversized(comps, frame(spark, one + two), s).filter("group_id is not null").collect():
        got.setdefault(r["group_id"], set()).add(r["image_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, _split_plain(one, s) + _split_plain(two, s)))


def test_split_of_unlike_members_ends(spark):
    """Every centre takes itself only: as many centres as members, in a few rounds."""
    rows = [row(f"/s/{i:04d}.jpg", ((i * 0x9E3779B97F4A7C15) & (2**63 - 1))) for i in range(700)]
    assert _split(spark, rows, CAP) == sorted(map(sorted, _split_plain(rows, CAP)))


def test_split_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """5,000 members of which every centre keeps only itself: the prefixes grow by a factor, and no table of pairs is
    larger than stated."""
    n, prefixes, pairs = 5000, [], []
    rows = [row(f"/s/{i:05d}.jpg", (i * 0x9E3779B97F4A7C15 + 7) & (2**63 - 1)) for i in range(n)]
    take, meet = split._prefix, split._meetings
    monkeypatch.setattr(split, "_prefix", lambda *a: prefixes.append(take(*a)) or prefixes[-1])
    monkeypatch.setattr(split, "_meetings", lambda *a: pairs.append(meet(*a)) or pairs[-1])
    total = {r["image_id"]: t for r, t in zip(rows, _totals([r["phash"] for r in rows]))}
    order = sorted(total, key=lambda i: (total[i], i))
    assert _split(spark, rows, CAP) == [sorted(order[-10:])]
    assert len(prefixes) <= 4
    assert all(p.count() <= split.PAIRS_PER_NODE * n + split.FIRST_STEP**2 for p in pairs)


def _totals(hashes):
    ones = [sum(h >> k & 1 for h in hashes) for k in range(64)]
    return [sum(len(hashes) - ones[k] if h >> k & 1 else ones[k] for k in range(64)) for h in hashes]


def test_split_of_one_dense_hash(spark):
    """Two crowded hashes whose members are all alike: their first centres take them, and no pairs are listed."""
    rows = [row(f"/a/{i:04d}.jpg", 0, brightness=100 + i / 100) for i in range(400)]
    rows += [row(f"/b/{i:04d}.jpg", 2**40 - 1, brightness=100 + i / 100) for i in range(600)]
    assert _split(spark, rows, CAP) == sorted(map(sorted, _split_plain(rows, CAP)))


def test_vertex_ids_stay_whole_beyond_doubles(spark):
    """Node ids of far partitions times the number of configurations pass 2^53."""
    from twinframe.operators.similarity import _components_of

    combos, first = 87, 2**60 // 87
    nodes = spark.createDataFrame([(first + k, f"/{k}") for k in range(4)], "node_id long, image_id string")
    edges = spark.createDataFrame([(first * combos + 5, (first + 3) * combos + 5)], "src long, dst long")
    got = {(r["node_id"], r["combo_id"], r["component"]) for r in _components_of(nodes, edges, combos).collect()}
    assert got == {(first, 5, "/0"), (first + 3, 5, "/0")}
