"""Splitting looks for near pairs among the members left only, and goes on where a whole prefix is gone."""

from itertools import combinations, islice

from builders import row
from test_grouping import CAP, _split, _split_plain

from twinframe.operators import split


def test_a_prefix_that_is_gone_ends_no_component(spark, monkeypatch):
    """The first centre takes all of the next prefix, and more than the cap are left behind it."""
    monkeypatch.setattr(split, "FIRST_STEP", 2)
    monkeypatch.setattr(split, "PAIRS_PER_NODE", 0)
    rows = [row(f"/a/{i:02d}.jpg", 1 << i) for i in range(50)]
    rows += [row(f"/b/{i:02d}.jpg", (i * 0x9E3779B97F4A7C15 + 7) & (2**63 - 1)) for i in range(30)]
    assert _split(spark, rows, CAP) == sorted(map(sorted, _split_plain(rows, CAP)))


def test_near_pairs_of_a_component_are_not_listed(spark, monkeypatch):
    """1,200 unlike hashes that are all near each other."""
    s = CAP.with_(threshold=6, use_dual_hash=False)
    rows = [row(f"/a/{i:04d}.jpg", sum(1 << b for b in bits)) for i, bits in enumerate(islice(combinations(range(30), 3), 1200))]
    counts = []
    original = split.materialise

    def counted(df, name):
        out = original(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(split, "materialise", counted)
    assert _split(spark, rows, s) == [sorted(r["image_id"] for r in rows)]
    assert max(counts) <= split.PAIRS_PER_NODE * len(rows)
