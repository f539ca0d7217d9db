import random
import re

from twinframe.llm import near_dedup
from twinframe.llm.near_dedup import deduplicated, near_duplicates


def brute(rows, size=5):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    lowest = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    return sorted(((rows[k][0], len(sets[k]), lowest[group[k]]) for k in range(len(rows))), key=repr)


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_brute_force_in_dense_groups(spark, documents):
    """Copies with enough changes that many pairs of a group lie on either side of the limit."""
    rng = random.Random(5)
    rows = []
    for base in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120))]
        rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + k, mutated(rng, words, rng.randint(0, 6))) for k in range(25)]
    rows += [(900, None), (901, ""), (902, "  "), (903, "One two"), (904, "one\ttwo"), (905, "one two three"),
             (906, rows[0][1].upper().lower()), (0, rows[0][1]), (None, rows[1][1]), (None, "only here and nowhere else at all"), (907, "y" * 20_000)]
    got = near_duplicates(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id if r.component_id is not None else True) for r in got)


def test_pairs_grow_linearly_with_a_group_beside_its_pivot(spark, documents, monkeypatch):
    """m copies around a core that shares table cells with the pivot of a larger group, but not the threshold."""
    m, rng, counts = 60, random.Random(9), []
    words = [f"w{k}" for k in range(200)]
    other = list(words)
    for k in range(8):
        other[12 + 24 * k] = f"x{k}"
    near = lambda base, k: " ".join(base[:k + 3] + [f"m{rng.randrange(10**9)}"] + base[k + 4:])
    rows = [(k, near(words, k)) for k in range(2 * m)] + [(1000 + k, near(other, k)) for k in range(m)]
    for name in ("_first_of_items", "_between_components"):
        pick = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda *a, pick=pick: counts.append(pick(*a)) or counts[-1])
    got = near_duplicates(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert {r.component_id for r in got} == {0, 1000}
    assert sum(c.count() for c in counts) <= 6 * m


def test_one_row_stays_of_each_group(spark, documents):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (7, "other words " * 9), (8, None)]
    kept = deduplicated(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8]


def test_empty_table(spark, documents):
    assert near_duplicates(documents([(1, "a")]).limit(0)).collect() == []


def test_large_components_meet_by_member(spark):
    """Of 200 members of one component a single one has room for the 50 others: 50 meetings, not 10,000."""
    from twinframe.llm.near_dedup import _between_components, _members_met

    schema = "src long, linked boolean, g long, size long, at int, item long, component long"
    rows = [(k, True, 0, 3 if k else 900, 0, 7, 0) for k in range(200)]
    rows += [(1000 + k, False, 35000, 900, 0, 7, 1000 + k) for k in range(50)]
    heads = spark.createDataFrame(rows, schema)
    assert _members_met(heads, 75).filter("cb >= 1000 and a.src < 1000").count() == 50
    pairs = {tuple(r) for r in _between_components(heads, 75).filter("src < 1000").collect()}
    assert pairs == {(0, 1000 + k) for k in range(50)}
