import datetime as dt
import random
import re

import pytest

from twinframe.operators import cache, folders, naming
from twinframe.plans import calibrate, ground_truth, merge, organise, trash
from twinframe.functions.paths import with_path_parts

from builders import EPOCH, frame, row


def _claim(claims, existing):
    taken, out = set(existing), {}
    for phase, name, target in sorted((p, i, t) for i, t, p in claims):
        final, k = target, 0
        stem, ext = re.match(r"(.*?)(\.[^./]+)?$", target).groups()
        while final in taken:
            k += 1
            final = f"{stem}_{k}{ext or ''}"
        taken.add(final)
        out[name] = final
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_names_equal_claiming_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = ["/m/a.jpg", "/m/a_1.jpg", "/m/a_1_1.jpg", "/m/a_2.jpg", "/m/b", "/m/b_1", "/m/c.d.jpg", "/m/a_02.jpg"]
    claims = [(f"/s/{i:03d}", rng.choice(pool), rng.randrange(2)) for i in range(60)]
    existing = rng.sample(pool, 3) + ["/m/a_5.jpg", "/m/b_3", "/m/a_1_2.jpg"]
    df = spark.createDataFrame(claims, "id string, target string, phase int")
    there = spark.createDataFrame([(e,) for e in existing], "path string")
    got = {r["id"]: r["final"] for r in naming.assign_targets(df, there).collect()}
    assert got == _claim(claims, existing)


def test_free_names_of_many_small_forests(spark):
    """Families that share names over several levels, in a folder of their own each."""
    rng, claims, existing = random.Random(11), [], []
    for d in range(120):
        pool = [f"/{d}/{n}" for n in ("a", "a_1", "a_1_1", "a_1_1_1", "a_2", "a_3", "a_2_1", "a_1_2", "b_1.x", "b.x", "b_1_1.x")]
        some = rng.sample(pool, rng.randint(2, 7))
        existing += rng.sample(pool, rng.randint(0, 3))
        claims += [(f"/s/{d}/{k:03d}/{rng.random()}", rng.choice(some), rng.randrange(2)) for k in range(rng.randint(1, 14))]
    # The parent's second claim would reach the child's name after its first one has had it.
    claims += [("1", "/t/a", 0), ("2", "/t/a_1", 0), ("3", "/t/a_1_1", 0), ("4", "/t/a_1", 0), ("0", "/t/a", 0)]
    df = spark.createDataFrame(claims, "id string, target string, phase int")
    there = spark.createDataFrame([(e,) for e in existing], "path string")
    got = {r["id"]: r["final"] for r in naming.assign_targets(df, there).collect()}
    assert got == _claim(claims, existing)


def test_a_chain_of_150_names_ends(spark):
    """Each family passes the name below on to the next."""
    claims = [(f"{k:03d}", "/m/a" + "_1" * k, 0) for k in range(150)] + [("00", "/m/a", 0)]
    claims += [(f"x{k:03d}", "/n/b" + ("" if k == 0 else f"_{k}"), 0) for k in range(150)] + [(f"w{k}", "/n/b", 0) for k in range(3)]
    df = spark.createDataFrame(claims, "id string, target string, phase int")
    got = {r["id"]: r["final"] for r in naming.assign_targets(df, df.selectExpr("target as path").limit(0)).collect()}
    assert got == _claim(claims, [])
    assert got["149"] == "/m/a" + "_1" * 150


def _members(spark, groups):
    return spark.createDataFrame(
        [(g, p, "original" if i == 0 else "preview", False, False) for g, paths in groups.items() for i, p in enumerate(paths)],
        "group_id string, image_id string, role string, is_series boolean, is_ambiguous boolean")


def test_merge(spark):
    rows = [row("/main/a.jpg", size=1, width=10, height=10), row("/s1/a.jpg", size=2), row("/s1/d/u.jpg", size=4),
            row("/s2/u.jpg", size=8), row("/s2/r.cr2", size=16), row("/s1/r.jpg", size=32), row("/s1/r2.jpg", size=64, width=1)]
    f = frame(spark, rows)
    m = _members(spark, {"g1": ["/s1/a.jpg", "/main/a.jpg"], "g2": ["/s2/r.cr2", "/s1/r.jpg", "/s1/r2.jpg"]})
    ops = merge.merge_plan(m, f, "/main", ["/s1", "/s2"]).collect()
    assert {(r["from_path"], r["to_path"], r["role"], r["renamed"]) for r in ops} == {
        ("/s1/a.jpg", "/s1/a.jpg", "duplicate", False), ("/s2/r.cr2", "/main/r.cr2", "original", False),
        ("/s1/r.jpg", "/main/r.jpg", "original", False), ("/s1/r2.jpg", "/s1/r2.jpg", "duplicate", False),
        ("/s1/d/u.jpg", "/main/u.jpg", "unique", False), ("/s2/u.jpg", "/main/u_1.jpg", "unique", True)}
    copy = merge.merge_plan(m, f, "/main", ["/s1", "/s2"], "nondestructive", keep_subfolder=True)
    rows = {r["from_path"]: (r["to_path"], r["role"]) for r in copy.collect()}
    assert rows["/s1/d/u.jpg"] == ("/main/d/u.jpg", "unique") and rows["/s1/a.jpg"][1] == "source_trash"
    assert tuple(merge.merge_summary(copy, "nondestructive").first()) == (2, 2, 4, 0, 4 + 8 + 16 + 32)
    listing = f.selectExpr("image_id as path")
    gone = merge.merge_trash(copy, "nondestructive", listing).collect()
    assert {r["to_path"] for r in gone} == {"/s1/trash/a.jpg", "/s1/trash/r2.jpg"}


def test_organise_policies(spark):
    rows = [row("/src/x/IMG_1.jpg", mtime=0), row("/src/y/IMG_1.jpg", mtime=5), row("/src/2024-01-01/z.jpg", mtime=0),
            row("/src/x/old_20191224.jpg", mtime=0), row("/src/x/raw.cr2", mtime=0)]
    f = frame(spark, rows).withColumnRenamed("image_id", "path")
    names = [r["image_id"] for r in rows] + ["/src/2024-01-01/IMG_1.jpg", "/src/x/IMG_1.xmp", "/src/x/IMG_1.XMP", "/src/y/IMG_1.AAE"]
    listing = with_path_parts(spark.createDataFrame([(p,) for p in names], "path string"), "path")
    plan = lambda **k: {r["from_path"]: (r["to_path"], r["status"].split(":")[0]) for r in
                        organise.organise_plan(f, listing, "/src", **k).collect()}
    got = plan()
    assert got["/src/x/IMG_1.jpg"] == ("/src/2024-01-01/IMG_1_1.jpg", "planned")
    assert got["/src/y/IMG_1.jpg"] == ("/src/2024-01-01/IMG_1_2.jpg", "planned")
    assert got["/src/2024-01-01/z.jpg"][1] == "skipped"
    assert got["/src/x/old_20191224.jpg"][0] == "/src/2019-12-24/old_20191224.jpg"
    assert got["/src/x/IMG_1.xmp"][0] == "/src/2024-01-01/IMG_1.xmp" and "/src/x/IMG_1.XMP" not in got
    assert got["/src/y/IMG_1.AAE"][0] == "/src/2024-01-01/IMG_1.AAE"
    skip = plan(conflict="skip", out="/out", include_raw=False)
    assert skip["/src/x/IMG_1.jpg"] == ("/out/2024-01-01/IMG_1.jpg", "planned") and "/src/x/raw.cr2" not in skip
    assert skip["/src/y/IMG_1.jpg"][1] == "skipped"
    none = organise.organise_plan(f, listing, "/src", use_mtime=False, use_filename=False, conflict="overwrite", operation="copy")
    assert tuple(organise.organise_summary(none).first()) == (5, 0, 5, 0, 0, 5, 2)


def test_trash_and_revert(spark):
    m = _members(spark, {"g1": ["/a/x.jpg", "/b/x.jpg", "/c/x.jpg"], "g2": ["/a/y.jpg", "/gone/y.jpg"]})
    listing = spark.createDataFrame([(p,) for p in ["/a/x.jpg", "/b/x.jpg", "/c/x.jpg", "/a/y.jpg", "/out/trash/x.jpg"]], "path string")
    plan = trash.trash_manifest(m, "/out", listing)
    assert {(r["from_path"], r["to_path"], r["status"]) for r in plan.collect()} == {
        ("/b/x.jpg", "/out/trash/x_1.jpg", "planned"), ("/c/x.jpg", "/out/trash/x_2.jpg", "planned"),
        ("/gone/y.jpg", "", "skipped: file not found")}
    done = plan.filter("status = 'planned'").replace("planned", "moved", "status")
    back = trash.revert_manifest(done, listing.filter("path <> '/c/x.jpg'"), ["g1"])
    assert {(r["from_path"], r["to_path"]) for r in back.collect()} == {
        ("/out/trash/x_1.jpg", "/b/x_1.jpg"), ("/out/trash/x_2.jpg", "/c/x.jpg")}


def test_cache_modes(spark):
    rows = [row("/a/1.jpg", rotations=(1, 2, 3)), row("/a/2.cr2", rotations=(1, 2, 3), mode="embedded"),
            row("/a/3.cr2", rotations=(1, 2, 3), mode=""), row("/a/4.jpg"), row("/a/5.jpg", rotations=(1, 2, 3), mode="embedded")]
    cached = frame(spark, rows)
    listing = frame(spark, rows + [row("/a/6.jpg")])
    miss = lambda **k: sorted(r["image_id"] for r in cache.split_by_cache(listing, cached, **k)[1].collect())
    assert miss() == ["/a/3.cr2", "/a/4.jpg", "/a/6.jpg"]
    assert miss(hash_mode="") == ["/a/2.cr2", "/a/4.jpg", "/a/6.jpg"]
    assert miss(trust=True) == ["/a/3.cr2", "/a/6.jpg"]


def test_cache_of_ancestors(spark):
    entries = [("/p", "/p/f/a"), ("/p/f", "/p/f/a"), ("/", "/p/f/b"), ("/p", "/p/f/b"), ("/p", "/p/other"), ("/p/g", "/p/g/a")]
    c = spark.createDataFrame(entries, "cache_root string, image_id string")
    tracked = c.selectExpr("cache_root as path").distinct()
    got = {(r["cache_root"], r["image_id"]) for r in cache.merged_cache(c, tracked, "/p/f").collect()}
    assert got == {("/p/f", "/p/f/a"), ("/p", "/p/f/b")}


def test_fingerprints(spark):
    import hashlib

    files = spark.createDataFrame([("/a", f"n{i:03d}") for i in range(70)] + [("/b", "x")], "dir string, name string")
    got = {r["dir"]: r["fingerprint"] for r in folders.folder_fingerprints(files).collect()}
    sha = lambda names: hashlib.sha256("\n".join(names).encode()).hexdigest()
    first = {r["dir"]: r["fingerprint"] for r in folders.first_names_fingerprints(files).collect()}
    assert first == {"/a": sha([f"n{i:03d}" for i in range(50)]), "/b": sha(["x"])}

    def plain(names):
        digests = [hashlib.sha256(n.encode()).hexdigest() for n in names]
        sums = [str(sum(int(d[16 * k:16 * k + 16], 16) for d in digests)) for k in range(4)]
        return hashlib.sha256(":".join([str(len(names)), *sums]).encode()).hexdigest()

    assert got == {"/a": plain([f"n{i:03d}" for i in range(70)]), "/b": plain(["x"])}
    changed = files.filter("name <> 'n069'")
    assert folders.folder_fingerprints(changed).filter("dir = '/a'").first()["fingerprint"] != got["/a"]
    tracked = spark.createDataFrame([("/a", got["/a"]), ("/b", "old"), ("/c", sha([]))], "path string, folder_fingerprint string")
    seen = {r["path"]: r["matches"] for r in folders.verify_fingerprints(tracked, files).collect()}
    assert seen == {"/a": True, "/b": False, "/c": True}


def test_calibration(spark):
    rows = [row("/t/groups/one/a.jpg", 0, size=9), row("/t/groups/one/b.jpg", 0, width=600, height=400),
            row("/t/groups/two/a.jpg", 2**40 - 1, size=5), row("/t/groups/two/b.jpg", 2**40 - 1, size=9),
            row("/t/groups/lonely/a.jpg", 5), row("/t/negatives/n/a.jpg", 0x3333333333333333), row("/t/negatives/n/b.jpg", 0x3333333333333333, size=2),
            row("/t/singles/s.jpg", 0xF0F0F0F0F0F0F0F0), row("/t/singles/deep/x.jpg", 1), row("/t/groups/one/notes.txt")]
    f = frame(spark, rows).withColumn("path", __import__("pyspark.sql.functions", fromlist=["col"]).col("image_id"))
    truth = ground_truth.load_ground_truth(f, "/t")
    assert tuple(ground_truth.validate_ground_truth(truth).first()) == (2, 1, 1, True)
    refined = ground_truth.refine_originals(truth, f)
    assert {r["path"] for r in refined.filter("is_original").collect()} == {"/t/groups/one/a.jpg", "/t/groups/two/b.jpg"}
    from twinframe.config import Settings
    scored = calibrate.score_settings(f, truth, [Settings(use_histogram=False)]).first()
    assert (scored["groups_found"], scored["groups_strict"], scored["originals_correct"], scored["previews_correct"]) == (2, 2, 2, 2)
    assert (scored["false_positives"], scored["negatives_correct"]) == (0, 0)
    assert abs(scored["score"] - (4 + 2 + 2 + 1) / (6 + 2 + 1 + 3)) < 1e-12
    timed = spark.createDataFrame([("base", 4.0, 0.0), ("fast", 1.0, -3.0), ("mid", 2.0, -1.0)], "variant string, seconds double, accuracy_delta double")
    tiers = {r["tier"]: r["variant"] for r in calibrate.speed_tiers(timed.selectExpr("*", "4.0D as base_seconds")).collect()}
    assert tiers == {"no loss": "base", "2 points": "mid", "5 points": "fast", "10 points": "fast"}
