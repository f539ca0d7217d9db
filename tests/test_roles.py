import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.operators import classify as cl
from twinframe.operators.classify import classify
from twinframe.operators.compare import compare_roles, compare_summary, union_sides
from twinframe.operators.groups import borderline_groups, find_groups

from builders import EPOCH, frame, ham, row, signed

PLAIN = Settings(use_histogram=False)


def roles_of(spark, rows, s, group="g"):
    """Roles of rows known to be one group, or of several groups by the folder name."""
    groups = spark.createDataFrame([(r["image_id"], r["dir"]) for r in rows], "image_id string, group_id string")
    out = {}
    for r in classify(groups, frame(spark, rows), s).collect():
        out[r["image_id"]] = ("S" if r["is_series"] else "") + r["role"][0]
    return out


def test_cases_of_one_scan(spark):
    """Many small groups at once; a folder is a group."""
    rows = [
        # a shot as RAW and JPEG: nothing to remove
        row("/raw/a.cr2", width=6024, height=4020), row("/raw/a.jpg"),
        # the same turned on its side
        row("/turned/a.cr2", width=4020, height=6024), row("/turned/a.jpg"),
        # a thumbnail beside a RAW file
        row("/thumb/a.cr2", width=6024, height=4020), row("/thumb/a.jpg", width=600, height=400),
        # nearly full size is kept
        row("/near/a.cr2", width=6036, height=4020), row("/near/a.jpg", width=5700, height=3800),
        # byte copies: the larger file stays; ties go to the first path
        row("/copy/a.jpg", size=5), row("/copy/b.jpg", size=9), row("/copy/c.jpg", size=9),
        # a second JPEG of the same shot goes
        row("/extra/a.cr2", width=6024, height=4020), row("/extra/a.jpg", size=9), row("/extra/b.jpg", size=5),
        # unknown sizes stay
        row("/zero/a.jpg", width=0, height=0), row("/zero/b.jpg", width=0, height=0),
        # PNG and JPEG of one size: the two bucket members are one picture
        row("/png/a.png", size=9), row("/png/a.jpg", size=5),
    ]
    got = roles_of(spark, rows, PLAIN)
    assert got == {
        "/thumb/a.cr2": "o", "/thumb/a.jpg": "p",
        "/copy/b.jpg": "o", "/copy/a.jpg": "p", "/copy/c.jpg": "p",
        "/extra/a.cr2": "So", "/extra/a.jpg": "So", "/extra/b.jpg": "Sp",
        "/png/a.png": "o", "/png/a.jpg": "p",
    }
    one = roles_of(spark, rows, PLAIN.with_(keep_all_formats=False))
    assert {k: v for k, v in one.items() if k.startswith(("/raw", "/turned", "/near", "/extra"))} == {
        "/raw/a.cr2": "So", "/raw/a.jpg": "Sp", "/turned/a.cr2": "So", "/turned/a.jpg": "Sp",
        "/extra/a.cr2": "So", "/extra/a.jpg": "Sp", "/extra/b.jpg": "Sp",
    }


def test_bursts_turned_copies_and_tolerance(spark):
    base = 0x0F0F0F0F0F0F0F0F
    far = base ^ (2**64 - 1)
    rows = [
        # seven bits across, each near the medoid: a burst; the small one is a preview
        row("/burst/a.jpg", base), row("/burst/b.jpg", base ^ 0b111), row("/burst/c.jpg", base ^ 0b11110000),
        row("/burst/s.jpg", base, width=600, height=400),
        # turned upside down: one picture
        row("/turn/a.jpg", base, size=2000), row("/turn/b.jpg", far, rotations=(None, base, None)),
        # two pictures of one size, too far apart for a burst: both stay, unless series detection is off
        row("/apart/a.jpg", base, size=2000), row("/apart/b.jpg", far),
        # sizes within one percent
        row("/tol/a.jpg", base, size=9), row("/tol/b.jpg", base, width=5990, height=3990),
    ]
    s = PLAIN.with_(threshold=4)
    got = roles_of(spark, rows, s)
    assert {k: v for k, v in got.items() if k.startswith("/burst")} == {
        "/burst/a.jpg": "So", "/burst/b.jpg": "So", "/burst/c.jpg": "So", "/burst/s.jpg": "Sp"}
    assert got["/turn/a.jpg"] == "o" and got["/turn/b.jpg"] == "p"
    assert not any(k.startswith(("/apart", "/tol")) for k in got)
    wide = roles_of(spark, rows, s.with_(series_tolerance_pct=1.0))
    assert wide["/tol/a.jpg"] == "o" and wide["/tol/b.jpg"] == "p"
    off = roles_of(spark, rows, s.with_(keep_all_formats=False, disable_series_detection=True))
    assert off["/apart/b.jpg"] == "p"


def test_scan_of_a_burst_in_two_formats(spark):
    shot = [(0xACF5F21884E3996C, 0xEE2FC6E3F7FB9F93), (0xADE5F2188CE3916C, 0x6E07C7E3F7FB8F93)]
    rows = []
    for i, (p, d) in enumerate(shot):
        when = EPOCH + dt.timedelta(seconds=2 * i)
        rows += [row(f"/s/{i}.cr2", p, d, 6024, 4020, exif=when), row(f"/s/{i}.jpg", p, d, exif=when)]
    found = find_groups(frame(spark, rows), PLAIN.with_(threshold=4, keep_all_formats=False)).collect()
    assert {(r["group_id"], r["image_id"], r["role"]) for r in found} == {
        ("/s/0.cr2", "/s/0.cr2", "original"), ("/s/0.cr2", "/s/0.jpg", "preview"),
        ("/s/1.cr2", "/s/1.cr2", "original"), ("/s/1.cr2", "/s/1.jpg", "preview")}
    # Kept formats leave nothing to remove, so the same files are free for review.
    s = PLAIN.with_(threshold=3, ambiguous_detection=True)
    amb = find_groups(frame(spark, rows), s).collect()
    assert {r["is_ambiguous"] for r in amb} == {True} and len(amb) == 4


def test_oldest_strategy(spark):
    rows = [row("/o/IMG_20200101.jpg", mtime=50), row("/o/b.jpg", mtime=10), row("/o/c.jpg", mtime=60, exif=dt.datetime(2019, 1, 1))]
    keeps = lambda **k: [i for i, r in roles_of(spark, rows, PLAIN.with_(keep_strategy="oldest", **k)).items() if r == "o"]
    assert keeps() == ["/o/b.jpg"]
    assert keeps(sort_by_filename_date=True) == ["/o/IMG_20200101.jpg"]
    assert keeps(sort_by_filename_date=True, sort_by_exif_date=True) == ["/o/c.jpg"]


def test_compare_sides(spark):
    rows = [row("/m/a.jpg"), row("/c/a.jpg"), row("/c/x.jpg", 99, size=3), row("/c/y.jpg", 99, size=5),
            row("/m/p.jpg", 7), row("/m/q.jpg", 7)]
    f = frame(spark, rows)
    both = union_sides(f.filter("dir = '/m'"), f.filter("dir = '/c'"))
    ids = {0: "g1", 99: "g2", 7: "g3"}
    groups = spark.createDataFrame([(ids[r["phash"]], r["image_id"], "original", False, False, False) for r in rows],
                                   "group_id string, image_id string, role string, is_series boolean, is_ambiguous boolean, in_series boolean")
    got = compare_roles(groups, both)
    assert {(r["image_id"], r["role"], r["match"]) for r in got.collect()} == {
        ("/m/a.jpg", "original", "cross"), ("/c/a.jpg", "preview", "cross"),
        ("/c/y.jpg", "original", "check"), ("/c/x.jpg", "preview", "check")}
    assert tuple(compare_summary(got).first()) == (1, 1, 1, 1, 2)


def _distance(a, b):
    """Rotation distance of two tuples of an upright hash and three turned ones (or none)."""
    return min([ham(a[0], b[0])] + [ham(a[0], x) for x in b[1:] if x is not None] + [ham(x, b[0]) for x in a[1:] if x is not None])


def _sets(spark, buckets, limit):
    rows = [(k, b[0][0], limit, *s) for k, b in buckets.items() for s in b]
    sets = spark.createDataFrame(rows, "k int, start long, limit int, phash long, phash_r90 long, phash_r180 long, phash_r270 long")
    return sets.select("k", F.struct("phash", *cl.ROTATIONS).alias("me"), "start", "limit")


@pytest.mark.parametrize("limit", [2, 3, 6])
def test_far_apart_equals_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(cl, "TASK_PAIRS", 20)
    rng, buckets = random.Random(limit), {}
    for k in range(40):
        centre = [rng.getrandbits(63) for _ in range(4)]
        flips = rng.choice([limit // 2, limit // 2, limit // 2 + 1, limit])
        bucket = []
        for _ in range(rng.randint(3, 14)):
            turn = rng.choice([0, 0, 1, 2, 3])
            words = centre[turn:] + centre[:turn]
            for i in range(4):
                for b in rng.sample(range(62), rng.randint(0, flips)):
                    words[i] ^= 1 << b
            bucket.append(tuple([words[0]] + [None if rng.random() < 0.1 else w for w in words[1:]]))
        buckets[k] = bucket
    turned = {k for k, b in buckets.items() if any(_distance(x, y) > limit for x, y in combinations(b, 2))}
    sets = _sets(spark, buckets, limit)
    got = {r.k for r in cl._far_apart(sets, ["k"], ["phash", *cl.ROTATIONS], cl.rotation_distance).collect()}
    assert got == turned and 3 < len(turned) < 40
    upright = {k for k, b in buckets.items() if any(ham(x[0], y[0]) > limit for x, y in combinations(b, 2))}
    alone = sets.withColumn("me", F.struct("me.phash"))
    assert {r.k for r in cl._far_apart(alone, ["k"], ["phash"], lambda a, b: cl.hamming(a["phash"], b["phash"])).collect()} == upright


def test_a_large_bucket_of_turned_copies_is_linear_work(spark, monkeypatch):
    """100,000 hash sets around one picture in two orientations: nothing is left to compare but the rim, which is empty."""
    rims, real = [], cl.materialise
    monkeypatch.setattr(cl, "materialise", lambda df, name="step": rims.append((name, real(df, name))) or rims[-1][1])
    a, b = 0x0F0F33335555AAAA, 0x3C3C0F0F12345678
    flip = lambda word, n: F.lit(word).bitwiseXOR(F.expr(" | ".join(f"shiftleft(1L, cast(pmod(xxhash64(id, {n}, {i}), 62) as int))" for i in range(3))))
    up = F.col("id") % 2 == 0
    ids = spark.range(100_000)
    sets = ids.select(
        F.lit(1).alias("k"), F.struct(
            F.when(up, flip(a, 1)).otherwise(flip(b, 1)).alias("phash"), F.when(up, flip(b, 2)).otherwise(flip(a, 2)).alias("phash_r90"),
            F.lit(None).cast("long").alias("phash_r180"), F.lit(None).cast("long").alias("phash_r270")).alias("me"),
        F.lit(a).alias("start"), F.lit(6).alias("limit"))
    assert cl._far_apart(sets, ["k"], ["phash", *cl.ROTATIONS], cl.rotation_distance).isEmpty()
    assert [df.count() for name, df in rims if name == "rim"] == [0]


def test_close_set_limits():
    assert [cl.close_set_limit(r) for r in (0, 1, 2, 3, 4)] == [1, 2, 65, 128, 2081]


@pytest.mark.parametrize("same_format,tolerance", [(True, 2.0), (True, 0.7), (False, 0.0)])
def test_size_buckets_equal_all_pairs(spark, same_format, tolerance):
    rng = random.Random(int(tolerance * 10))
    rows = set()
    for g in range(6):
        w, h = rng.randint(300, 6000), rng.randint(300, 6000)
        for _ in range(60):
            a, b = (round(x * (1 + rng.uniform(-0.09, 0.09))) for x in (w, h))
            rows.add((f"g{g}", min(a, b), max(a, b), rng.random() < 0.4))
    rows |= {("edge", 98, 100, False), ("edge", 100, 100, False), ("edge", 100, 102, False), ("edge", 49, 50, True), ("edge", 50, 50, False)}
    rows = sorted(rows)
    near = lambda a, b, t: max(abs(a[1] - b[1]) / max(a[1], b[1]), abs(a[2] - b[2]) / max(a[2], b[2])) <= t
    group = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            limit = (max(0.02, tolerance / 100) if same_format else 0.02) if a[3] != b[3] else tolerance / 100 if same_format else -1
            if a[0] == b[0] and near(a, b, limit):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    want = {}
    for r, g in zip(rows, group):
        want.setdefault(g, []).append(r)
    members = spark.createDataFrame(rows, "group_id string, lo int, hi int, is_raw boolean").withColumn("cfg", F.lit(None).cast("string"))
    p = cl.Params(Settings(series_tolerance_pct=tolerance))
    got = {}
    for r in cl.size_buckets(members, same_format, tolerance, p).collect():
        got.setdefault(r.bucket, []).append((r.group_id, r.lo, r.hi, r.is_raw))
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in want.values() if len(x) > 1)
