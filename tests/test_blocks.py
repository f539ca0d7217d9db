"""Nodes that meet in blocks give the components of all pairs, and dense places list few of them."""

import pytest
from builders import components, frame, random_rows, row
from test_grouping import _split, _split_plain

from twinframe.config import Settings
from twinframe.operators import blocks, similarity, split

MIXED = [Settings(threshold=t, low_entropy=4.4, **more) for t in (1, 4, 14) for more in (
    {}, {"use_dual_hash": False}, {"raw_use_embedded_thumb": False})]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 12)
    monkeypatch.setattr(similarity, "NEAREST_FIRST", 0)


@pytest.mark.parametrize("settings", [MIXED, [Settings(threshold=6, use_dual_hash=False)]])
def test_blocks_give_the_components_of_all_pairs(spark, small_blocks, settings):
    rows = random_rows(150, 6)
    got = similarity.similarity_components_grid(frame(spark, rows), settings).collect()
    for i, s in enumerate(settings):
        assert {r.image_id: r.component for r in got if r.combo_id == i} == components(rows, s)


def test_pairs_of_a_dense_place_are_not_listed(spark, small_blocks, monkeypatch):
    """200 files within four bits are 19,900 near pairs under each threshold."""
    rows = [row(f"/d/{i}.jpg", sum(1 << k for k in range(8) if i >> k & 1), brightness=100 + i / 10) for i in range(200)]
    met = []
    original = similarity.near_nodes
    monkeypatch.setattr(similarity, "near_nodes", lambda *a: met.append(original(*a)) or met[-1])
    settings = [Settings(threshold=t) for t in (2, 8, 20)]
    got = similarity.similarity_components_grid(frame(spark, rows), settings).collect()
    assert len(got) == 600 and len({(r.combo_id, r.component) for r in got}) == 3
    assert sum(pairs.count() for pairs in met) < 3000


def test_wide_settings_meet_in_blocks(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCKED", (0, 1000))
    monkeypatch.setattr(similarity, "near_hashes", None)
    rows = random_rows(100, 7)
    for s in (Settings(threshold=6, use_histogram=False), Settings(raw_use_embedded_thumb=False)):
        got = {r.image_id: r.component for r in similarity.similarity_components(frame(spark, rows), s).collect()}
        assert got == components(rows, s)


def test_default_settings_meet_in_blocks(spark, small_blocks, monkeypatch):
    """Tables of middle size have no stages, whose plans fill the driver."""
    monkeypatch.setattr(similarity, "BLOCKED", (0, 1000))
    monkeypatch.setattr(similarity, "near_hashes", None)
    rows = random_rows(100, 8)
    got = {r.image_id: r.component for r in similarity.similarity_components(frame(spark, rows), Settings()).collect()}
    assert got == components(rows, Settings())


@pytest.mark.parametrize("most", [10**6, 0])
def test_members_of_a_split_meet_in_blocks(spark, small_blocks, monkeypatch, most):
    """In blocks or by keys: the groups of one centre after the other."""
    monkeypatch.setattr(split, "MOST_BLOCKED", most)
    monkeypatch.setattr(split, "near_between" if most else "near_of_scopes", None)
    monkeypatch.setattr(split, "FIRST_STEP", 4)
    monkeypatch.setattr(split, "PAIRS_PER_NODE", 0)
    s = Settings(max_group_size=8, threshold=4, low_entropy=4.4)
    rows = random_rows(90, seed=9, centres=5)
    assert _split(spark, rows, s) == sorted(map(sorted, _split_plain(rows, s)))
