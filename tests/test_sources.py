import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.config import Settings
from twinframe.operators.groups import find_groups
from twinframe.sources import tables
from twinframe.sources.exif import parse_exif
from twinframe.sources.images import image_features
from twinframe.sources.listing import list_files, list_videos

from builders import frame, ham, row


def exif_block(order="<"):
    """A TIFF structure with a camera, an orientation, and a sub-directory with a date and an exposure."""
    make, date = b"Maker\0", b"2024:03:15 12:00:00\0"
    ifd0 = 8
    sub = ifd0 + 2 + 3 * 12 + 4
    data = sub + 2 + 2 * 12 + 4
    e = lambda tag, kind, count, value: struct.pack(order + "HHI", tag, kind, count) + value
    long = lambda v: struct.pack(order + "I", v)
    out = (b"II*\0" if order == "<" else b"MM\0*") + long(ifd0)
    out += struct.pack(order + "H", 3) + e(271, 2, len(make), long(data)) + e(274, 3, 1, struct.pack(order + "HH", 6, 0))
    out += e(34665, 4, 1, long(sub)) + long(0)
    out += struct.pack(order + "H", 2) + e(33434, 5, 1, long(data + 6 + 20)) + e(36867, 2, len(date), long(data + 6)) + long(0)
    return out + make + date + struct.pack(order + "II", 1, 250)


def png(pixels, exif=None):
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    if exif:
        out += chunk(b"eXIf", exif)
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed, w=96, h=64):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 255, (8, 12, 3))
    return np.kron(coarse, np.ones((h // 8, w // 12, 1))).astype(np.uint8)


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    block = exif_block(order)
    want = {"Make": "Maker", "Orientation": "6", "ExposureTime": "0.004", "DateTimeOriginal": "2024:03:15 12:00:00"}
    assert parse_exif(block) == want
    assert parse_exif(png(picture(1), block)) == want
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
    assert parse_exif(jpeg) == want
    assert parse_exif(b"nothing") == {} and parse_exif(block[:60]) != want


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    base = picture(7)
    pictures = {"base.png": base, "other.png": picture(8)}
    for k in (1, 2, 3):
        pictures[f"turn{90 * k}.png"] = np.ascontiguousarray(np.rot90(base, k))
    (root / "sub").mkdir()
    for name, pixels in pictures.items():
        (root / "sub" / name).write_bytes(png(pixels))
    # Stored on its side, with the tag that sets it upright.
    (root / "sub" / "tagged.png").write_bytes(png(np.ascontiguousarray(np.rot90(base, 1)), exif_block()))
    (root / "bad.jpg").write_bytes(b"not a picture")
    (root / "clip.mp4").write_bytes(b"x")
    (root / "empty.MOV").write_bytes(b"")
    return str(root)


def test_listing(spark, library):
    names = lambda df: sorted(r["name"] for r in df.select("name").collect())
    assert len(names(list_files(spark, library))) == 8  # all but the empty one
    assert names(list_files(spark, library, recursive=False)) == ["bad.jpg", "clip.mp4"]
    assert names(list_videos(spark, library)) == ["clip.mp4"]
    plan = list_files(spark, library)._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_pixels_to_groups(spark, library):
    features, broken = image_features(spark, library)
    rows = {r["name"]: r for r in features.collect()}
    assert [r["name"] for r in broken.collect()] == ["bad.jpg"] and len(rows) == 6
    base, tagged = rows["base.png"], rows["tagged.png"]
    assert (base["width"], base["height"]) == (96, 64) and (tagged["width"], tagged["height"]) == (96, 64)
    assert base["phash"] == tagged["phash"] and base["dhash"] == tagged["dhash"]
    assert tagged["metadata_count"] == 4 and str(tagged["exif_date"]) == "2024-03-15 12:00:00"
    assert abs(sum(base["histogram"]) - 3) < 1e-9 and len(base["histogram"]) == 96
    assert ham(rows["turn90.png"]["phash"], base["phash_r90"]) <= 2
    assert ham(base["phash"], rows["other.png"]["phash"]) > 10
    found = find_groups(features, Settings()).collect()
    assert {r["image_id"].rsplit("/", 1)[1] for r in found} == {"base.png", "turn90.png", "turn180.png", "turn270.png", "tagged.png"}
    assert len({r["group_id"] for r in found}) == 1


def test_stored_tables(spark, tmp_path):
    f = frame(spark, [row("/a/x.jpg", size=2048), row("/a/y.jpg"), row("/a/z.jpg")])
    at = str(tmp_path / "cache")
    tables.save_feature_cache(f, at, "/a")
    tables.save_feature_cache(frame(spark, [row("/b/q.jpg")]), at, "/b/")
    tables.save_feature_cache(f.filter("name <> 'z.jpg'"), at, "/a")
    names = lambda df: sorted(r["image_id"] for r in df.collect())
    assert names(tables.load_feature_cache(spark, at)) == ["/a/x.jpg", "/a/y.jpg", "/b/q.jpg"]
    assert names(tables.load_feature_cache(spark, at, "/b")) == ["/b/q.jpg"]

    tables.save_feature_cache(tables.load_feature_cache(spark, at, "/a").drop("cache_root").filter("name = 'x.jpg'"), at, "/a")
    tables.save_feature_cache(f.filter("false"), at, "/b")
    assert names(tables.load_feature_cache(spark, at)) == ["/a/x.jpg"]

    v1 = spark.createDataFrame([("/a/v.mp4", 5, None, 7)], "path string, size bigint, mtime timestamp, phash bigint")
    tables.save_video_cache(v1, str(tmp_path / "v"), "/a")
    old = tables.load_video_cache(spark, str(tmp_path / "v"), "/a").first()
    assert old["duration"] is None and old["frame_hashes"] == []

    ops = spark.createDataFrame([("trash", "/a", "/b", "moved", "g1")], "type string, from_path string, to_path string, status string, group_id string")
    for run in ("r1", "r2"):
        tables.append_manifest(ops, str(tmp_path / "ops"), run)
    assert tables.load_manifest(spark, str(tmp_path / "ops")).count() == 2
    assert tables.load_manifest(spark, str(tmp_path / "ops"), "r2").first()["role"] is None

    folders = spark.createDataFrame([("/p/a", "", "", "", None, 1), ("/q", "", "", "", None, 1)], "path string, drive_type string, volume_serial string, folder_fingerprint string, last_updated timestamp, file_count bigint")
    entry = folders.limit(1).withColumn("path", F.lit("/p"))
    tables.save_tracked_folders(tables.set_folder(folders, entry), str(tmp_path / "folders"))
    assert sorted(r["path"] for r in tables.load_tracked_folders(spark, str(tmp_path / "folders")).collect()) == ["/p", "/q"]

    index = tables.load_tracked_folders(spark, str(tmp_path / "folders"))
    tables.save_tracked_folders(tables.without_folder(index, index.filter("path = '/q'")), str(tmp_path / "folders"))
    assert [r["path"] for r in tables.load_tracked_folders(spark, str(tmp_path / "folders")).collect()] == ["/p"]

    members = spark.createDataFrame([("g", "/a/x.jpg", "original", False, False), ("g", "/a/y.jpg", "preview", False, False)], "group_id string, image_id string, role string, is_series boolean, is_ambiguous boolean")
    tables.save_results(members, f, f.limit(0).withColumnRenamed("image_id", "path"), str(tmp_path / "results"), "s1")
    assert sorted(r["role"] for r in tables.load_results(spark, str(tmp_path / "results"), "s1").collect()) == ["original", "preview", "solo"]
    tables.save_csv(members, f, str(tmp_path / "csv"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert csv.columns == tables.CSV_COLUMNS and csv.filter("path = '/a/x.jpg'").first()["file_size_kb"] == "2.0"
    tables.save_group_documents(members, f, str(tmp_path / "json"))
    doc = spark.read.json(str(tmp_path / "json")).first()
    assert [d["filename"] for d in doc["previews"]] == ["y.jpg"]


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    """Both when the rows fail to be written and when the log is never told of them."""
    at = str(tmp_path / "cache")
    names = lambda: sorted(r["image_id"] for r in tables.load_feature_cache(spark, at).collect())
    assert names() == []
    tables.save_feature_cache(frame(spark, [row("/a/x.jpg")]), at, "/a")
    tables.save_feature_cache(frame(spark, [row("/b/x.jpg")]), at, "/b")
    held = tables.load_feature_cache(spark, at, "/a")
    bad = frame(spark, [row("/a/y.jpg"), row("/a/z.jpg")]).withColumn(
        "file_size", F.when(F.col("name") == "z.jpg", F.raise_error(F.lit("stopped")).cast("long")).otherwise(F.col("file_size")))
    with pytest.raises(Exception, match="stopped"):
        tables.save_feature_cache(bad, at, "/a")
    assert names() == ["/a/x.jpg", "/b/x.jpg"]

    def crash(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tables, "_point_at", crash)
        with pytest.raises(RuntimeError, match="killed"):
            tables.save_feature_cache(frame(spark, [row("/a/new.jpg")]), at, "/a")
    assert names() == ["/a/x.jpg", "/b/x.jpg"]
    tables.save_feature_cache(frame(spark, [row("/a/new.jpg")]), at, "/a")
    assert names() == ["/a/new.jpg", "/b/x.jpg"] and held.count() == 1  # a reader of the old snapshot keeps it
    assert tables.drop_old_snapshots(spark, at) == 3 and names() == ["/a/new.jpg", "/b/x.jpg"]

    folders = str(tmp_path / "folders")
    index = spark.createDataFrame([("/p", "", "", "", None, 1)], "path string, drive_type string, volume_serial string, folder_fingerprint string, last_updated timestamp, file_count bigint")
    tables.save_tracked_folders(index, folders)
    with pytest.raises(Exception, match="stopped"):
        tables.save_tracked_folders(index.withColumn("path", F.raise_error(F.lit("stopped")).cast("string")), folders)
    assert [r["path"] for r in tables.load_tracked_folders(spark, folders).collect()] == ["/p"]
