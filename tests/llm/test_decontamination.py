import hashlib
import random
import re

from twinframe.llm.decontamination import contaminated_words, uncontaminated

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - width + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k:k + width]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k:k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, documents):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma", "d3", "é"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate([25, 12, 10, 9, 4, 1, 3])] + [(50, None), (51, "..."), (52, "rare one"), (None, some(12)), (2, "second text " * 6)]
    rows = [(k, some(rng.randint(0, 60))) for k in range(20)] + [
        (100, items[0][1].upper()), (101, f"x-{items[1][1].replace(' ', '--')}!"), (102, None), (103, ""), (104, "..."), (None, items[0][1]),
        (105, "rare, ONE"), (105, "another text under the same id"), (106, "second text " * 30), (106, "second text " * 30), (107, "z" * 30_000)]
    return documents(rows), spark.createDataFrame(items, "item_id long, text string"), rows, items


def test_equals_brute_force(spark, documents):
    docs, benchmark, rows, items = tables(spark, documents)
    got = contaminated_words(docs, benchmark).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, items)
    clean = [r[0] for r in brute(rows, items) if not r[5]]
    assert sorted((r.doc_id for r in uncontaminated(docs, benchmark).collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark, documents):
    docs, benchmark, rows, _ = tables(spark, documents)
    assert contaminated_words(docs.limit(0), benchmark).collect() == []
    got = contaminated_words(docs, benchmark.limit(0)).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)


def test_no_python_in_the_plan(spark, documents):
    docs, benchmark, _, _ = tables(spark, documents)
    plan = contaminated_words(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
