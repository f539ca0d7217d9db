import hashlib
import random
import re
from collections import Counter

import pytest

from twinframe.llm.substring_dedup import is_cover, removal_digests, remove_repeated_windows


def brute(rows, length):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    met = Counter(tuple(w[k:k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = {k + d for k in range(len(w) - length + 1) if met[tuple(w[k:k + length])] > 1 for d in range(length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,period,cover", [(35, 21, (3, 6, 7, 12, 14)), (9, 7, (1, 2, 4)), (7, 7, (1, 2, 4))])
def test_equals_brute_force(spark, documents, length, period, cover):
    rng = random.Random(length)
    passage = " ".join(rng.choice("abcdefgh") * 2 for _ in range(length + 5))
    rows = [(k, " ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 3 * length)))) for k in range(25)]
    rows += [(100 + k, f"{' x' * k} {passage}\t{'z ' * k}") for k in range(6)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, rows[3][1]), (3, rows[3][1]), (None, "w " * 90), (204, "q" * 50_000)]
    got = remove_repeated_windows(documents(rows), length, period, cover).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows, length)


def test_digests_and_empty_table(spark, documents):
    rows = [(1, "a b c"), (2, "a  b c")]
    got = {r.doc_id: r.kept_sha256 for r in removal_digests(documents(rows)).collect()}
    assert got == {k: hashlib.sha256(b"a b c").hexdigest() for k in (1, 2)}
    assert removal_digests(documents(rows).limit(0)).collect() == []


def test_a_cover_needs_all_differences(documents):
    assert is_cover((3, 6, 7, 12, 14), 21) and not is_cover((0, 1), 7)
    with pytest.raises(ValueError):
        remove_repeated_windows(documents([(1, "a")]), 35, 7, (0, 1))
