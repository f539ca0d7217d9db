import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinframe.config import Params, Settings
from twinframe.operators.predicates import PairRule

from builders import EPOCH, FLAT, NARROW, frame, random_rows, row, similar

PLAIN = Settings(use_histogram=False)


def decide(spark, a, b, s):
    df = frame(spark, [a]).select(F.struct("*").alias("a")).join(frame(spark, [b]).select(F.struct("*").alias("b")))
    r = PairRule(F.col("a"), F.col("b"), Params(s))
    got = df.select(r.similar, r.blocked_by).first()
    assert got[0] == (got[1] is None)
    assert got[0] == similar(a, b, s)
    return got[1]


def test_date_guard(spark):
    at = lambda s: EPOCH + dt.timedelta(seconds=s)
    raw = lambda d: row("/x/a.cr2", width=6024, height=4020, exif=d)
    jpg = lambda d: row("/x/a.jpg", exif=d)
    assert decide(spark, raw(at(0)), jpg(at(301)), PLAIN) == "date"
    assert decide(spark, raw(at(0)), jpg(at(300)), PLAIN) is None
    assert decide(spark, raw(at(0)), jpg(None), PLAIN) is None
    assert decide(spark, row("/x/b.jpg", exif=at(0)), jpg(at(9999)), PLAIN) is None


def test_low_entropy_needs_the_second_hash(spark):
    flat = lambda name, d: row(name, 0, d, hist=NARROW)
    assert decide(spark, flat("/a.jpg", 0), flat("/b.jpg", 0), Settings()) is None
    assert decide(spark, flat("/a.jpg", 0), flat("/b.jpg", 0b11), Settings()) is None
    assert decide(spark, flat("/a.jpg", 0), flat("/b.jpg", 0b1111), Settings()) == "dHash"
    assert decide(spark, row("/a.jpg", 0, 0), row("/b.jpg", 0, 0xFFFF), Settings()) is None


def test_false_rotation_of_flat_pictures(spark):
    a, b = 0x99266699666699DC, 0xCCCC333333CCCCCC
    near = a ^ 0b111111
    pair = lambda h: (row("/a.jpg", a, hist=h), row("/b.jpg", b, hist=h, rotations=(None, near, None)))
    assert decide(spark, *pair(NARROW), Settings()) == "pHash"
    assert decide(spark, *pair(FLAT), Settings()) is None


def test_boundaries(spark):
    s = PLAIN.with_(threshold=4)
    jpg = lambda n, **k: row(f"/{n}.jpg", **k)
    assert decide(spark, jpg("a"), jpg("b", phash=0b1111), s) is None
    assert decide(spark, jpg("a"), jpg("b", phash=0b11111), s) == "pHash"
    assert decide(spark, jpg("a"), jpg("b", phash=1, dhash=0b111), s) is None
    assert decide(spark, jpg("a"), jpg("b", phash=1, dhash=0b1111), s) == "dHash"
    assert decide(spark, jpg("a", brightness=100), jpg("b", brightness=160), s) is None
    assert decide(spark, jpg("a", brightness=100), jpg("b", brightness=160.5), s) == "brightness"
    # Dark pictures halve the threshold, and never below 1.
    assert decide(spark, jpg("a", brightness=39), jpg("b", brightness=60, phash=0b111), s) == "pHash"
    assert decide(spark, jpg("a", brightness=40), jpg("b", brightness=60, phash=0b111), s) is None
    # The rotation floor comes after dark tightening.
    turned = jpg("b", brightness=60, phash=2**64 - 1, rotations=(0b111111, None, None))
    assert decide(spark, jpg("a", brightness=39), turned, s) is None
    assert decide(spark, jpg("a"), jpg("b", width=4000, height=6000), s) is None
    assert decide(spark, jpg("a"), jpg("b", width=4000, height=4000), s) == "AR"


def test_cross_format_modes(spark):
    raw, jpg = row("/a.cr2", 0), row("/a.jpg", 0xFFF, dhash=0xFFFF)
    s = PLAIN.with_(threshold=20)
    assert decide(spark, raw, jpg, s) == "pHash"
    assert decide(spark, raw, jpg, PLAIN.with_(raw_use_embedded_thumb=False)) is None
    assert decide(spark, raw, row("/a.jpg", 0x1FFF), PLAIN.with_(raw_use_embedded_thumb=False)) == "pHash"


VARIANTS = [
    Settings(), Settings(threshold=6, low_entropy=4.4), Settings(threshold=5, raw_use_embedded_thumb=False),
    Settings(threshold=8, series_threshold_factor=0.5, series_tolerance_pct=2.0, use_histogram=False),
    Settings(threshold=0, use_dual_hash=False, dark_tighten_factor=1.0, hist_min_similarity=0.2),
]


@pytest.mark.parametrize("s", VARIANTS)
def test_column_form_equals_plain_arithmetic(spark, s):
    rows = random_rows(70, seed=s.threshold, centres=3)
    df = frame(spark, rows)
    a, b = df.select(F.struct("*").alias("a")), df.select(F.struct("*").alias("b"))
    rule = PairRule(F.col("a"), F.col("b"), Params(s))
    got = {(x, y) for x, y in a.crossJoin(b).filter(rule.similar).select("a.image_id", "b.image_id").collect()}
    want = {(x["image_id"], y["image_id"]) for x in rows for y in rows if similar(x, y, s)}
    assert got == want and len(want) > len(rows)
