"""The pipeline against its stages by brute force, over a small copy of the tables."""

import os
import random

import corpus_pipeline
import pytest
from test_decontamination import brute as contaminated
from test_near_dedup import brute as near
from test_quality_rules import brute as measures

from twinframe.llm import pii, segmentation


@pytest.mark.skipif(not os.path.exists(segmentation.MODEL), reason="no vocabulary file")
def test_pipeline(spark, documents, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    items = [(k, text(30)) for k in range(3)]
    rows = [(k, text(rng.randint(60, 90))) for k in range(30)]
    rows += [(100 + k, rows[k][1] + " tail") for k in range(5)] + [(200, f"{text(60)} {items[1][1]}"), (201, text(60) + " a@b.c"), (202, None), (203, "")]
    documents(rows).drop("bucket", "text_hash").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [r for r in rows if not measures(r[1])[5]]
    left = [r for r in left if (r[0], r[0]) in {(i, c) for i, _, c in near(left)}]
    left = [r for r in left if r[0] in {i for i, *_, hit in contaminated(left, items) if not hit}]
    got = corpus_pipeline.run(spark, str(tmp_path))
    vocabulary = segmentation.Vocabulary.read(segmentation.MODEL)
    found = {r.doc_id: vocabulary.decode(r.ids) for r in got.collect()}
    assert found == {i: pii.redact(t) for i, t in left} and 201 in found and found[201].endswith("<EMAIL>")
    assert 200 not in found and 100 not in found


@pytest.mark.skipif(not os.path.exists(segmentation.MODEL), reason="no vocabulary file")
def test_pipeline_with_bad_labels(spark, documents, tmp_path):
    rng = random.Random(10)
    text = lambda end="": " ".join(f"w{rng.randrange(10**5)}{end}" for _ in range(60))
    bad = {k for k in range(150) if k % 5 == 0}
    documents([(k, text("##" if k in bad else ""), "fr") for k in range(150)]).drop("bucket", "text_hash").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, int(k not in bad), 0) for k in range(140)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(150)) - bad


@pytest.mark.skipif(not os.path.exists(segmentation.MODEL), reason="no vocabulary file")
def test_pieces_holds_every_segmentation(spark, documents):
    docs = documents([(1, "reading and writing of many words"), (2, "")])
    ranks = {}
    for r in corpus_pipeline.pieces(spark, docs, "").collect():
        ranks.setdefault(r.doc_id, set()).add(r.rank)
    assert ranks == {1: set(range(1, segmentation.BEST + 1)), 2: {1}}
