import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from twinframe.llm import quality_rules as q


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    met = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    repeated = {k + d for k in range(len(w) - 2) if met[tuple(w[k:k + 3])] > 1 for d in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(repeated), failed


def corpus(rng, n):
    """Good documents, bad ones full of symbols, and labels."""
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [f"w{rng.randrange(10**6)}" + ("##" if bad else "") for _ in range(60)]
        rows.append((k, " ".join(words), "en" if k % 2 else "de"))
        labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_counts_equal_brute_force(spark, documents):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice(["a ", "b ", "c\n", "#é ", "\t", "x y z ", "😀 "]) for _ in range(rng.randint(0, 90)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a b c"), (104, "a a a a"), (None, "one two " * 40), (0, rows[0][1]), (105, "q" * 50_000)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.judged(documents(rows), labels).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr)
    assert found == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all(r.kept == (not r.base_failed) for r in got)


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 20, 0.1), (40, 5000, 0.0125), (0, 200_000, 0.0125), (5, 5, 0.3)]
    for k, n, rate in cases:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)) for i in range(k + 1))
        got = spark.range(1).select(q.binomial_tail(F.lit(k), F.lit(n), rate)).first()[0]
        assert math.isclose(got, exact, rel_tol=1e-9, abs_tol=1e-300)


def test_certified_cutoffs_reject_bad_and_keep_good(spark, documents):
    rows, labels = corpus(random.Random(2), 4000)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows)
    cut = {(r.lang, r.rule): r.cutoff for r in q.certified_cutoffs(q.measured(docs), labels).collect()}
    assert set(cut) == {("en", "symbols"), ("de", "symbols")} or {("en", "symbols"), ("de", "symbols")} <= set(cut)
    kept = {r.doc_id for r in q.judged(docs, labels).filter("kept").collect()}
    assert kept == {k for k, _, _ in rows if k % 5}
    assert {r.doc_id for r in q.accepted(docs, labels).collect()} == kept


def test_few_labels_certify_nothing(spark, documents):
    rows, labels = corpus(random.Random(2), 200)
    labels = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert q.certified_cutoffs(q.measured(documents(rows)), labels).collect() == []
    assert q.judged(documents(rows).limit(0), labels).collect() == []


def test_rules_tested_together_need_fewer_labels(spark, documents):
    """120 good documents behind the base rules in a stratum: about 90 in the holdout, where single rules need 459."""
    rows, labels = corpus(random.Random(2), 300)
    rows = [(k, t + " " + "q" * 400 if k % 5 and k % 60 == 1 else t, lang) for k, t, lang in rows]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    measures = q.measured(documents(rows))
    assert q.certified_cutoffs(measures, labels).collect() == []
    cut = q.jointly_certified_cutoffs(measures, labels).collect()
    assert {(r.lang, r.rule) for r in cut} == {("en", "symbols"), ("de", "symbols")}
    assert {r.doc_id for r in q.accepted(documents(rows), labels).collect()} == {k for k, _, _ in rows if k % 5}
    # Labels that say nothing about the texts certify no more than the whole budget.
    rng = random.Random(4)
    mixed = spark.createDataFrame([(k, rng.randrange(2), 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    assert q.jointly_certified_cutoffs(measures, mixed).collect() == []


def test_no_python_in_the_plan(spark, documents):
    rows, labels = corpus(random.Random(2), 50)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plan = q.judged(documents(rows), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
