"""Pages, remainders and speed tiers."""

import pytest

from twinframe.config import Settings
from twinframe.operators import summary
from twinframe.operators.split import split_oversized
from twinframe.plans import calibrate

from builders import components, frame, random_rows, row
from test_grouping import _split_plain

MEMBERS = "group_id string, image_id string, root string"


def test_pages(spark):
    rows = [(f"g{g:02d}", f"/{m}/{g}.jpg", f"/{m}") for g in range(45) for m in ("a", "b" if g % 2 else "c")]
    members = spark.createDataFrame(rows, MEMBERS)
    solos = spark.createDataFrame([("/s/1.jpg",), ("/s/2.jpg",)], "image_id string")
    got = {}
    for r in summary.paged(members, solos).collect():
        got.setdefault(r["page"], set()).add((r["group_id"], r["image_id"]))
    assert [len(got[p]) for p in sorted(got)] == [40, 40, 10, 2] and got[4] == {(None, "/s/1.jpg"), (None, "/s/2.jpg")}
    assert {g for g, _ in got[3]} == {f"g{g}" for g in range(40, 45)}
    none = members.limit(0)
    assert {r["page"] for r in summary.paged(none, solos).collect()} == {2} and summary.paged(none, solos.limit(0)).collect() == []

    folders = summary.folder_pages(members).collect()
    assert {(r["page"], r["folder"]) for r in folders} == {(1, "/a"), (2, "/b"), (3, "/c")}
    assert len([r for r in folders if r["page"] == 1]) == 90 and len([r for r in folders if r["page"] == 2]) == 44
    assert summary.folder_pages(none).collect() == []


@pytest.mark.parametrize("seed", [3, 8])
def test_remainder_is_linked_again(spark, seed):
    """A remainder is cut into the groups its members make among themselves; centres keep what they took."""
    s = Settings(max_group_size=8, threshold=4, low_entropy=4.4)
    rows = random_rows(60, seed=seed, centres=6)
    comps = spark.createDataFrame([(r["image_id"], "c") for r in rows], "image_id string, component string")
    got = {}
    for r in split_oversized(comps, frame(spark, rows), s, recheck_remainder=True).collect():
        got.setdefault(r["group_id"], []).append(r["image_id"])
    alone = got.pop(None, [])
    assert len(alone) + sum(map(len, got.values())) == len(rows)
    plain = _split_plain(rows, s)
    taken = {i for g in plain for i in g}
    rest = plain[-1]
    by_id = {r["image_id"]: r for r in rows}
    linked = {}
    for i, root in components([by_id[i] for i in rest], s).items():
        linked.setdefault(root, []).append(i)
    expected = plain[:-1] + [g for g in linked.values() if len(g) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected)) and taken >= {i for g in expected for i in g}


def test_remainder_without_links(spark):
    """Two ends of a star of chains hold together through taken files only."""
    hashes = {"m": 0, "p": 0b11, "q": 0b1111, "x": 0b11 << 32, "y": 0b1111 << 32}
    rows = [row(f"/{k}.jpg", h) for k, h in hashes.items()]
    s = Settings(max_group_size=3, threshold=2, use_dual_hash=False, use_histogram=False, series_threshold_factor=1.0)
    comps = spark.createDataFrame([(r["image_id"], "c") for r in rows], "image_id string, component string")
    named = lambda again: {r["image_id"]: r["group_id"] for r in split_oversized(comps, frame(spark, rows), s, again).collect()}
    assert named(False) == {"/m.jpg": "/m.jpg", "/p.jpg": "/m.jpg", "/x.jpg": "/m.jpg", "/q.jpg": "/q.jpg", "/y.jpg": "/q.jpg"}
    assert named(True) == {"/m.jpg": "/m.jpg", "/p.jpg": "/m.jpg", "/x.jpg": "/m.jpg", "/q.jpg": None, "/y.jpg": None}


def test_variants(spark):
    assert len(calibrate.VARIANTS) == 11 and [v[2] for v in calibrate.VARIANTS] == [True] * 8 + [False] * 3
    f = frame(spark, [row("/a.jpg", 0), row("/b.jpg", 0, size=9)])
    bare = calibrate.without_metadata(f)
    assert bare.dtypes == f.dtypes and {(r["exif_date"], r["metadata_count"]) for r in bare.collect()} == {(None, 0)}
    timed = calibrate.time_variants(f, Settings(), 1, [calibrate.VARIANTS[0], calibrate.VARIANTS[8]]).collect()
    assert [r["variant"] for r in timed] == ["all guards", "all guards off, no metadata"]
    assert all(r["seconds"] > 0 and r["base_seconds"] == timed[0]["seconds"] for r in timed)
