"""Near cells listed in stages give the components of all pairs."""

import pytest
from builders import components, frame, random_rows, row

from twinframe.config import Settings
from twinframe.operators import candidates, similarity


def staged(spark, monkeypatch, rows, s, limit):
    monkeypatch.setattr(similarity, "STAGED", limit)
    listed = []
    original = similarity.near_hashes
    monkeypatch.setattr(similarity, "near_hashes", lambda *a, **k: listed.append(a[2]) or original(*a, **k))
    monkeypatch.setattr(similarity, "meeting_others", lambda *a: listed.append(a[2]) or candidates.meeting_others(*a))
    got = {r.image_id: r.component for r in similarity.similarity_components(frame(spark, rows), s).collect()}
    return got, listed


@pytest.mark.parametrize("s", [Settings(), Settings(threshold=6, use_dual_hash=False), Settings(raw_use_embedded_thumb=False)])
def test_stages_change_no_component(spark, monkeypatch, s):
    rows = random_rows(150, 5)
    got, listed = staged(spark, monkeypatch, rows, s, 0)
    assert got == components(rows, s)
    assert {2, 4} < set(listed)


def test_pairs_within_a_component_are_listed_once(spark):
    cells = spark.createDataFrame(
        [(("U", "false", 0, h), home) for h, home in ((0, 1), (1, 1), (3, 2), (7, None))],
        "cell struct<kind: string, cls: string, bin: long, hash: long>, home long")
    for near in (candidates.near_hashes, candidates.meeting_others):
        got = {tuple(sorted((r.u.hash, r.v.hash))) for r in near(cells, cells, 2, [0, 1], True).collect()}
        assert got == {(0, 3), (1, 3), (1, 7), (3, 7)}


def test_unturned_pairs_need_near_dhashes(spark):
    rows = [row(f"/d/{i}.jpg", 1 << i, 0 if i < 2 else 255 << 8 * i) for i in range(6)]
    nodes, _ = similarity.collapse(frame(spark, rows), similarity.PAIR_COLUMNS)
    _, pairs = similarity.pair_cells(nodes, [Settings()])
    assert [sorted((r.u.hash, r.v.hash)) for r in pairs.collect()] == [[1, 2]]
