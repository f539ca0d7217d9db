import datetime as dt

from pyspark.sql import functions as F

from twinframe.functions import dates, labels, paths
from twinframe.functions.hashing import hamming, hex_to_long, long_to_hex
from twinframe.functions.stats import histogram_entropy, histogram_similarity

from builders import FLAT, NARROW, entropy


def test_hashes(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("acf5f21884e3996c", "ade5f2188ce3916c"),
                                ("", "8000000000000000")], "a string, b string")
    a, b = hex_to_long(F.col("a")), hex_to_long(F.col("b"))
    got = [tuple(r) for r in df.select(a, long_to_hex(a), hamming(a, b), long_to_hex(b)).collect()]
    assert got == [(-1, "ffffffffffffffff", 64, "0000000000000000"),
                   (0xacf5f21884e3996c - 2**64, "acf5f21884e3996c", 4, "ade5f2188ce3916c"),
                   (None, None, None, "8000000000000000")]


def test_histograms(spark):
    df = spark.createDataFrame([(FLAT, NARROW), ([], FLAT), (FLAT, FLAT)], "a array<double>, b array<double>")
    rows = df.select(histogram_entropy(F.col("a")), histogram_entropy(F.col("b")),
                     histogram_similarity(F.col("a"), F.col("b"))).collect()
    assert abs(rows[0][0] - entropy(FLAT)) < 1e-9 and abs(rows[0][1] - entropy(NARROW)) < 1e-9
    assert rows[1][0] is None and abs(rows[2][2] - 1.0) < 1e-9
    assert abs(rows[0][2] - 2 / 32) < 1e-9


def test_dates_in_file_names(spark):
    cases = {
        "IMG_20240315_120001.jpg": dt.datetime(2024, 3, 15, 12, 0, 1),
        "2024-03-15_12-00-02.jpg": dt.datetime(2024, 3, 15, 12, 0, 2),
        "2024-03-15 12:00:03.png": dt.datetime(2024, 3, 15, 12, 0, 3),
        "20240315120004.jpg": dt.datetime(2024, 3, 15, 12, 0, 4),
        "Screenshot_2024-03-15.png": dt.datetime(2024, 3, 15),
        "DSC_20240315.jpg": dt.datetime(2024, 3, 15),
        "IMG_20241315.jpg": None, "19800101.jpg": None, "2041-01-01.jpg": None, "holiday.jpg": None,
        "2024-02-30.jpg": None, "20240315_990000.jpg": dt.datetime(2024, 3, 15),
        "2024-03-15_12-00-60.jpg": dt.datetime(2024, 3, 15),
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    got = {r[0]: r[1] for r in df.select("name", dates.filename_date(F.col("name"))).collect()}
    assert got == cases


def test_exif_dates(spark):
    rows = [({"DateTime": "2024:01:02 03:04:05", "DateTimeDigitized": "2023-01-02 03:04:05"},),
            ({"DateTimeOriginal": "nonsense", "DateTime": " 2024/01/02 03:04:05 "},), ({},)]
    df = spark.createDataFrame(rows, "exif map<string,string>")
    guard = [r[0] for r in df.select(dates.exif_date(F.col("exif"))).collect()]
    sort = [r[0] for r in df.select(dates.exif_date(F.col("exif"), dates.EXIF_TAGS_FOR_SORTING)).collect()]
    day = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert guard == [dt.datetime(2023, 1, 2, 3, 4, 5), day, None]
    assert sort == [day, day, None]


def test_date_folders(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 7, 8, 9),), (None,)], "d timestamp_ntz")
    show = lambda f: [r[0] for r in df.select(dates.date_folder(F.col("d"), f, "none")).collect()]
    assert show("%Y-%m-%d") == ["2024-03-05", "none"]
    assert show("%Y/%B year's %d") == ["2024/March year's 05", "none"]


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.tar.GZ",), ("/a/.hidden",), ("/a/plain",)], "path string")
    got = [tuple(r) for r in paths.with_path_parts(df, "path").collect()]
    assert got == [("/a/b/c.tar.GZ", "/a/b", "c.tar.GZ", "c.tar", ".gz"), ("/a/.hidden", "/a", ".hidden", ".hidden", ""),
                   ("/a/plain", "/a", "plain", "plain", "")]
    inside = df.select(paths.in_folder(F.col("path"), F.lit("/a/b/")), paths.in_folder(F.lit("/foobar"), F.lit("/foo")))
    assert [tuple(r) for r in inside.collect()] == [(True, False), (False, False), (False, False)]
    up = df.select(paths.ancestors(F.col("path"))).first()[0]
    assert up == ["/a", "/a/b"]


def test_labels(spark):
    df = spark.createDataFrame([(512 * 1024, 59), (3 * 1024**2, 61), (5 * 1024**3, 7300), (0, -4)], "b long, s int")
    got = [tuple(r) for r in df.select(labels.size_label(F.col("b")), labels.bytes_label(F.col("b")),
                                       labels.duration_label(F.col("s"))).collect()]
    assert got == [("512 KB", "512 KB", "59s"), ("3.00 MB", "3.0 MB", "1m 01s"), ("5120.00 MB", "5.0 GB", "2h 01m"),
                   ("0 KB", "–", "0s")]
