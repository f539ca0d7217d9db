import os
import random

import pyarrow as pa
import pytest

from twinframe.llm import segmentation as sg

pytestmark = pytest.mark.skipif(not os.path.exists(sg.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return sg.Vocabulary.read(sg.MODEL)


def every(v, chunk):
    """All segmentations of a short text with their scores."""
    if not chunk:
        return [(0.0, ())]
    out = []
    for size in range(1, min(v.longest, len(chunk)) + 1):
        found = v.pieces.get(chunk[:size])
        if found is None and size > 1:
            continue
        ids, score = ((found[0],), found[1]) if found else (tuple(v.bytes_ids(chunk[0])), v.unknown)
        out += [(score + s, ids + rest) for s, rest in every(v, chunk[size:])]
    return out


@pytest.mark.parametrize("n", [1, 2, 5])
def test_equals_enumeration(vocabulary, n):
    rng = random.Random(n)
    texts = ["".join(rng.choice("the of an  ti▁é\n😀") for _ in range(rng.randint(0, 9))) for _ in range(80)]
    for text, results in zip(texts, sg.Encoder(vocabulary, n).encode(pa.array(texts))):
        whole = sg.BLANK + text.replace(sg.BLANK, sg.LITERAL).replace(" ", sg.BLANK) if text else ""
        possible = every(vocabulary, whole)
        assert [r[0] for r in results] == sorted((s for s, _ in possible), reverse=True)[:n]
        ids = [tuple(r[1].tolist()) for r in results]
        assert len(set(ids)) == len(ids) and all((r[0], i) in possible for r, i in zip(results, ids))
        assert all((vocabulary.decode(i) if i else "") == text for i in ids)


def test_fractional_ties(monkeypatch):
    """Scores of one decimal, many of them tied: results are distinct, in order, and the same for short and long chunks."""
    rng = random.Random(5)
    pieces = {p: (300 + k, -rng.randint(1, 9) / 10) for k, p in enumerate(
        ["a", "b", "c", sg.BLANK, "ab", "bc", "ca", "abc", "aa", "bb", sg.BLANK + "a", sg.BLANK + "ab", "cab", "bca"])}
    v = sg.Vocabulary(pieces, list(range(256)))
    texts = ["".join(rng.choice("aabbc ") for _ in range(rng.randint(0, 11))) for _ in range(300)]
    results = [[(r[0], tuple(r[1].tolist())) for r in rs] for rs in sg.Encoder(v, 4).encode(pa.array(texts))]
    for text, got in zip(texts, results):
        possible = every(v, sg.BLANK + text.replace(" ", sg.BLANK) if text else "")
        assert [s for s, _ in got] == sorted((s for s, _ in possible), reverse=True)[:4]
        assert len({i for _, i in got}) == len(got) and set(got) <= set(possible)
        # Rank 1 has the longest last pieces.
        sizes = lambda ids: [len(v.bytes_of[i]) for i in reversed(ids)]
        assert sizes(got[0][1]) == max(sizes(i) for s, i in possible if s == got[0][0])
    monkeypatch.setattr(sg, "SHORT", 0)
    assert [[(r[0], tuple(r[1].tolist())) for r in rs] for rs in sg.Encoder(v, 4).encode(pa.array(texts))] == results


def test_long_chunks_take_the_single_search(vocabulary):
    text = "anti" * 20 + " of"
    short = sg.n_best(vocabulary, "".join(sg.chunks_of(text)), 4)
    results = next(iter(sg.Encoder(vocabulary, 4).encode(pa.array([text]))))
    assert [r[0] for r in results] == [s for s, _ in short]


def test_memory_is_cleared(vocabulary, monkeypatch):
    encoder = sg.Encoder(vocabulary, 2)
    first = [r[0][1].tolist() for r in encoder.encode(pa.array(["one two", "three"]))]
    monkeypatch.setattr(sg, "REMEMBERED", 0)
    assert [r[0][1].tolist() for r in encoder.encode(pa.array(["one two", "three"]))] == first


def test_tables(spark, documents):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (None, " x "), (1, "Hello  wörld"), (4, "ab" * 3000), (5, "▁ \u0000 😀")]
    got = sg.segmentations(documents(rows), 2).collect()
    assert all(r.round_trip for r in got) and all(r.n_pieces == len(r.ids) for r in got)
    assert sorted({(r.doc_id, r["rank"]) for r in got if r.doc_id in (2, 3)}) == [(2, 1), (3, 1)]
    back = {(r.doc_id, r["rank"]): r.text for r in sg.decoded(sg.segmentations(documents(rows), 2)).collect()}
    assert back[1, 1] == back[1, 2] == "Hello  wörld" and back[5, 1] == "▁ \u0000 😀" and back[2, 1] == ""
    assert sg.segmentation_digests(documents(rows).limit(0)).collect() == []
