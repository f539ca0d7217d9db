import random
import zlib

import numpy as np
import pytest

from twinframe.llm import sharding as sh


def smallest(sizes, shards):
    """The least capacity by trying every one that a run of groups has."""
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    runs = {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}
    return min(c for c in runs if fits(c))


def ends_of(spark, sizes):
    ends, at = [], 0
    for k, s in enumerate(sizes):
        at += s
        ends.append((at, k + 1))
    return spark.createDataFrame(ends, "end long, upto_rows long").coalesce(1), at, {e for e, _ in ends}


def test_minimax_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sh, "KNOWN", 80)  # several rounds even on small tables
    rng = random.Random(4)
    for _ in range(2):
        sizes = [rng.choice([16, 17, rng.randint(16, 90), rng.randint(16, 900)]) for _ in range(rng.randint(1, 60))]
        shards = rng.randint(1, 9)
        ends, total, values = ends_of(spark, sizes)
        capacity, cuts = sh.minimax_cuts(sh.Prefixes(ends, total), shards)
        assert capacity == smallest(sizes, shards)
        assert len(cuts) == shards + 1 and all(0 <= b - a <= capacity for a, b in zip(cuts, cuts[1:]))
        assert set(cuts) <= values | {0}


class InMemory(sh.Prefixes):
    """The same over an array, so that tables of any shape are quick."""

    def __init__(self, sizes):
        self.all = np.cumsum(sizes)
        super().__init__(None, int(self.all[-1]), int(sizes.max()))

    def slots(self, bounds, wanted):
        at = np.searchsorted(bounds, self.all, side="left")
        inside = np.flatnonzero(wanted[at])
        _, first, n = np.unique(at[inside], return_index=True, return_counts=True)
        a, b = inside[first], inside[first + n - 1]
        return list(zip(n.tolist(), self.all[a].tolist(), (a + 1).tolist(), self.all[b].tolist(), (b + 1).tolist()))


@pytest.mark.parametrize("share", [0, 0.04, 0.1, 0.5, 0.9])
def test_one_group_of_any_share(monkeypatch, share):
    monkeypatch.setattr(sh, "KNOWN", 1 << 12)
    rng = np.random.default_rng(int(share * 100))
    sizes = rng.integers(16, 6000, 50_000)
    if share:
        sizes[rng.integers(len(sizes))] = sizes.sum() * share / (1 - share)
    prefixes = InMemory(sizes)
    capacity, cuts = sh.minimax_cuts(prefixes, 40)
    assert prefixes.looks <= 8 and len(prefixes.values) <= 2 * sh.KNOWN * prefixes.looks

    def fits(c):
        at = 0
        for _ in range(40):
            k = np.searchsorted(prefixes.all, at + c, side="right")
            at = prefixes.all[k - 1] if k else 0
        return at == prefixes.total

    assert capacity >= sizes.max() and fits(capacity)
    assert capacity in (sizes.max(), -(-prefixes.total // 40)) or not fits(capacity - 1)
    assert len(cuts) == 41 and max(np.diff(cuts)) <= capacity and min(np.diff(cuts)) >= 0 and set(cuts) <= {0, *prefixes.all.tolist()}


def test_rows(spark, documents):
    rng = random.Random(6)
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(150)] + [(1000 + k, "hot text") for k in range(70)]
    rows += [(2000, None), (2001, None), (2002, ""), (None, "hot text"), (5, rows[5][1]), (2003, "é" * 900)]
    got = sh.byte_shards(documents(rows), 7).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    shards, slots, loads = {}, {}, {}
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert shards.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) <= sum(loads.values()) / 7 + max(1816, 71 * 24)


def test_empty_and_few(spark, documents):
    assert sh.byte_shards(documents([(1, "a")]).limit(0), 5).collect() == []
    got = sh.byte_shards(documents([(1, "a"), (2, "b")]), 5).collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}
