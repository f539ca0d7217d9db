import math
import random
import re

import numpy as np
import pyarrow as pa

from twinframe.llm import lexical_search
from twinframe.llm.lexical_search import ranked_documents

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, top=10):
    words = [(i, terms(t)) for i, t in rows]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, ws in words:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, ws in words:
            m = 25 + 75 * len(ws) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[q] + 1))) * (10**9 * ws.count(q) // (1000 * ws.count(q) + 8 * m))
                    for q in terms(text) if q in ws)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "Alpha", "x9"]
    some = lambda n: " ".join(vocabulary[int(rng.random() ** 2 * len(vocabulary))] for _ in range(n))
    rows = [(k, some(rng.randint(1, 60))) for k in range(150)] + [(1000 + k, "alpha, w1-w2 É") for k in range(60)]
    rows += [(None, "alpha w1"), (None, "rare"), (5, "w1 w1 second text"), (7, None), (8, ""), (9, "... !"), (10, "z" * 40_000), (11, "w3 " * 20_000)]
    items = [(k, some(rng.randint(1, 25))) for k in range(12)] + [(50, None), (51, "?!"), (52, "ALPHA w1"), (52, "ALPHA w1"), (52, "w2 w2 rare"), (None, "w5"), (53, "absent")]
    return rows, items


def test_equals_brute_force(spark, documents, monkeypatch):
    rows, items = fixture()
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = ranked_documents(documents(rows), benchmark)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, items)
    # Many small blocks of items give the same.
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 600)
    few = ranked_documents(documents(rows), benchmark, top=3)
    assert sorted((tuple(r) for r in few.collect()), key=repr) == brute(rows, items, 3)


def test_empty_tables(spark, documents):
    rows, items = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_documents(documents(rows).limit(0), benchmark).collect() == []
    assert ranked_documents(documents(rows), benchmark.limit(0)).collect() == []


def segment(texts, vocabulary):
    lengths, found, counts = lexical_search.counted(pa.array(texts), pa.array(vocabulary))
    n, total = len(texts), int(lengths.sum())
    return lexical_search.Segment(
        pa.array(range(len(texts))), lengths, np.asarray(found.offsets, np.int64), np.asarray(found.flatten()), np.asarray(counts.flatten()),
        len(vocabulary), n, total)


def test_stops_before_the_end():
    rng = random.Random(1)
    # Few short texts hold both terms, long ones one of them.
    texts = [rng.choice("ab") + " c" * rng.randint(100, 300) if k % 50 else "a b" + " c" * rng.randint(0, 20) for k in range(5000)]
    own = segment(texts, ["a", "b"])
    weights = np.array([700, 650])
    found, scored = own.best(np.array([0, 1]), weights, 10, 1)
    whole, _ = own.best(np.array([0, 1]), weights, 5000, 1)
    assert found == whole[:10] and scored < 400


def test_ties_at_the_last_place_go_by_id():
    own = segment(["a"] * 3000 + ["b"] * 3000, ["a", "b"])
    found, _ = own.best(np.array([0, 1]), np.array([5, 5]), 4, 1)
    assert [d for _, d in found] == [0, 1, 2, 3]
