import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinframe.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10, low=30, high=90):
    v = [(r, i, label, [math.floor(256 * x) for x in e]) for r, (i, e, label) in enumerate(rows)
         if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for r, i, label, e in v:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(e, f)), j, own == label, s) for s, j, own, f in v if s != r and len(f) == len(e)]
        for p in sorted((x for x in scored if x[2]), key=order)[:positives]:
            window = [x for x in scored if not x[2] and low * p[0] <= 100 * x[0] <= high * p[0]]
            out += [(i, p[1], k + 1, n[1], p[0], n[0]) for k, n in enumerate(sorted(window, key=order)[:negatives])]
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, tag int, score long, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def fixture():
    rng = random.Random(4)
    vector = lambda d=20: [round(rng.gauss(0, 0.2), 3) for _ in range(d)]
    hot = vector()
    rows = [(k, hot if k % 3 == 0 else vector(), rng.randint(0, 3) if k % 3 else 1) for k in range(450)]
    rows += [(500, None, 1), (501, [0.1, None] * 10, 1), (502, [float("nan")] * 20, 1), (503, [float("inf")] * 20, 2), (600, hot, None)]
    rows += [(None, vector(), 1), (None, hot, 2), (700, vector(5), 1), (701, vector(5), 1), (702, vector(5), 2), (-100, hot, 2), (800, [], 1),
             (900, [0.0] * 20, 1), (901, [0.0] * 20, 1)]
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    rows = fixture()
    got = hn.hard_negatives(table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert collected(got) == want and len(want) > 50
    # Many small blocks, parts and groups of anchors give the same.
    for name, value in [("BLOCK", 32), ("PART_BLOCKS", 2), ("GROUP_ANCHORS", 3)]:
        monkeypatch.setattr(hn, name, value)
    assert collected(hn.hard_negatives(table(spark, rows), positives=2, negatives=3, low=-50, high=60)) == brute(rows, 2, 3, -50, 60)


def test_label_may_be_given(spark):
    rows = fixture()
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    want = brute([(i, e, (label + 1) % 4 if i is not None and i % 7 == 0 and label is not None else label) for i, e, label in rows])
    assert collected(hn.hard_negatives(table(spark, rows), label=moved)) == want


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = fixture()[:60] + fixture()[:60]
    assert len(collected(hn.hard_negatives(table(spark, rows)))) == len(brute(rows))


def test_empty_table(spark):
    assert hn.hard_negatives(table(spark, fixture()).limit(0)).collect() == []
    assert hn.hard_negatives(table(spark, [(1, [0.5], 1)])).collect() == []


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_the_scan_drops_candidates_and_keeps_the_best(scale):
    rng = np.random.default_rng(0)
    data = (rng.normal(0, 60, (64, 2000)) * np.linspace(3, 0.1, 64)[:, None]).astype(np.int64) * scale
    block = hn.Columns(64, data.copy().ravel(), pa.array(range(2000)), np.arange(2000))
    vector = data[:, 17].copy()
    best, sizes = hn.Best(6), []

    def kept(lower, upper):
        sizes.append(len(lower))
        return best.reachable(lower, upper)

    best.add(block, *block.scan(vector, kept))
    exact = vector @ data
    want = sorted(range(2000), key=lambda k: (-exact[k], k))[:6]
    assert [r[4] for r in best.rows] == want and sizes[0] == 2000 and sizes[-1] < 200
