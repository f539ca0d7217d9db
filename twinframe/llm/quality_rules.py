"""Quality rules whose cutoffs come with a guarantee. DataFrame functions only.

Base rules reject what is too short or repeats itself. Behind them, each rule scores a document, and a cutoff rejects
scores above it. Cutoffs are chosen per stratum on labelled documents, in two parts split by ``doc_id``:

* the proposing part says which cutoffs are useful: those that reject more bad than good documents;
* the holdout certifies: with ``k`` of ``n`` good documents rejected, the exact binomial bound ``P(Bin(n, rate) <= k) <=
  level`` shows that at most ``rate`` of the good ones are rejected falsely. ``level`` is ``error`` divided by the number
  of strata times rules (Bonferroni); within one rule the cutoffs are tested from the mildest on and the first failure
  ends the test (fixed sequence), which costs nothing more. ``rate`` is ``false_rejection`` divided by the number of
  rules, so all rules together stay below ``false_rejection`` in every stratum, with confidence ``1 - error``.

Of the certified and useful cutoffs the one that rejects most bad documents of the proposing part is used, the mildest
on a tie. A stratum without labels, or with too few, gets no cutoff and rejects nothing beyond the base rules.

So ``judged`` works, and its SQL. ``accepted`` needs fewer labels for the same guarantee: the proposing part puts the
useful cutoffs of all rules of a stratum in one order, those that cost fewest good documents first, and the holdout tests
what the first 1, 2, ... of them reject together, at the whole ``false_rejection`` and at ``error`` by the number of strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.session import materialise

SEPARATORS = r"[\x20\x09-\x0D]+"
FEWEST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
FALSE_REJECTION = 0.05
ERROR = 0.05
#: Cutoffs of each score, mildest first. They are fixed beforehand, so the tests hold whatever the data are.
CUTOFFS = {
    "symbols": [2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "lines": [0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01],
    "long_words": [20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0],
}
PARTS = 4  # by doc_id; one proposes and the rest certify


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more: equal windows meet by sorting."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))

    def twice(s):
        met = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
        covered = F.flatten(F.transform(F.filter(s, met), lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
        return F.size(F.array_distinct(covered))

    return F.when(F.size(words) >= 4, bound(F.sort_array(windows), twice)).otherwise(0)


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, lang`` and the counts of the base rules. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = bound(F.array_remove(F.split(text, SEPARATORS), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).cast("long").alias("n_repeat_words")))
    two = documents.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "lang", counts.alias("c"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return two.select(
        "doc_id", "text_hash", "lang", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.n_lines"
    ).withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _part(doc_id: Column) -> Column:
    """One of ``PARTS`` parts; a plain sum, so that SQL can say it too."""
    return F.pmod(F.pmod(F.pmod(doc_id, F.lit(1000003)) * 7919, F.lit(10007)), F.lit(PARTS))


def scores() -> dict[str, Column]:
    words, long_as = F.greatest("n_words", F.lit(1)), F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words, "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "long_words": long_as,
    }


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """``P(Bin(n, rate) <= k)``, summed in logarithms from the term of 0 upwards."""
    ratio = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + ratio
        top = F.greatest(acc["sum"], term)
        total = top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))
        return F.struct(term.alias("term"), total.alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))
    return F.exp(F.aggregate(steps, start, add)["sum"])


def _labelled(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """``lang, good, proposes`` and the scores of labelled documents behind the base rules."""
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    return measures.filter(~F.col("base_failed")).join(known, "doc_id").select(
        F.coalesce("lang", F.lit("")).alias("lang"), (F.col("quality") == 1).alias("good"),
        (_part(F.col("doc_id")) == 0).alias("proposes"),
        *[value.alias(name) for name, value in scores().items()],
    )


def _cutoff_counts(seen: DataFrame) -> DataFrame:
    """What each cutoff alone rejects, by stratum."""
    # Sums over the whole table: one row per stratum, whatever the number of labels.
    counts = []
    for name, cutoffs in CUTOFFS.items():
        for k, cutoff in enumerate(cutoffs):
            over = F.col(name) > cutoff
            counts.append(F.struct(
                F.lit(name).alias("rule"), F.lit(k).alias("step"), F.lit(cutoff).alias("cutoff"),
                F.count_if(over & F.col("good") & ~F.col("proposes")).alias("k"),
                F.count_if(F.col("good") & ~F.col("proposes")).alias("n"),
                F.count_if(over & F.col("good") & F.col("proposes")).alias("good_out"),
                F.count_if(over & ~F.col("good") & F.col("proposes")).alias("bad_out"),
            ))
    return materialise(seen.groupBy("lang").agg(F.array(*counts).alias("rows")).select("lang", F.inline("rows")), "counts")


def certified_cutoffs(measures: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION,
                      error: float = ERROR) -> DataFrame:
    """``lang, rule, cutoff``: at most one cutoff per stratum and rule; see the module text.

    ``labels`` is ``(doc_id, quality)`` with 1 for good; rows with a null in either are left out, a document labelled
    twice counts twice.
    """
    table = _cutoff_counts(_labelled(measures, labels))
    rules, strata = len(CUTOFFS), max(1, table.select("lang").distinct().count())
    level = error / (rules * strata)
    tail = binomial_tail(F.col("k"), F.col("n"), false_rejection / rules)
    tested = table.withColumn("passes", (F.col("n") > 0) & (tail <= level))
    failed = tested.filter(~F.col("passes")).groupBy("lang", "rule").agg(F.min("step").alias("stop"))
    good = tested.join(failed, ["lang", "rule"], "left").filter(
        (F.col("stop").isNull() | (F.col("step") < F.col("stop"))) & (F.col("bad_out") > F.col("good_out")))
    return good.groupBy("lang", "rule").agg(
        F.max(F.struct("bad_out", (-F.col("step")).alias("mild"), "cutoff"))["cutoff"].alias("cutoff"))


def jointly_certified_cutoffs(measures: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION,
                              error: float = ERROR) -> DataFrame:
    """``lang, rule, cutoff`` as ``certified_cutoffs`` has them, with the rules of a stratum tested together.

    The smallest stratum that can be certified has ``log(error / strata) / log(1 - false_rejection)`` good documents in
    the holdout, none of them rejected: 59 for one stratum and 86 for four.
    """
    seen = materialise(_labelled(measures, labels), "labelled")
    table = _cutoff_counts(seen)
    level = error / max(1, table.select("lang").distinct().count())
    # At most one row per cutoff in a stratum, in an order that only the proposing part decides.
    order = Window.partitionBy("lang").orderBy("good_out", F.desc("bad_out"), "step", "rule")
    items = materialise(table.filter(F.col("bad_out") > F.col("good_out")).select(
        "lang", "rule", "cutoff", F.row_number().over(order).alias("place")), "order")
    # A document is rejected from the first place on whose cutoff it exceeds.
    lists = items.groupBy("lang").agg(F.collect_list(F.struct("rule", "cutoff", "place")).alias("items"))
    score = lambda rule: F.coalesce(*[F.when(rule == name, F.col(name)) for name in CUTOFFS])
    first = F.array_min(F.transform("items", lambda x: F.when(score(x["rule"]) > x["cutoff"], x["place"])))
    held = F.col("good") & ~F.col("proposes")
    met = seen.join(lists, "lang").select("lang", "good", "proposes", first.alias("place")).groupBy("lang", "place").agg(
        F.count_if(held).alias("k"), F.count_if(F.col("good") & F.col("proposes")).alias("good_out"),
        F.count_if(~F.col("good") & F.col("proposes")).alias("bad_out"))
    sizes = table.select("lang", "n").distinct()
    places = items.select("lang", "place").join(met, ["lang", "place"], "left").join(sizes, "lang")
    upto = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = places.select("lang", "place", "n", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("k", "good_out", "bad_out")])
    # What is rejected only grows with the place, so whatever passes comes before the first failure.
    passed = sums.filter((binomial_tail(F.col("k"), F.col("n"), false_rejection) <= level) & (F.col("bad_out") > F.col("good_out")))
    last = passed.groupBy("lang").agg(F.max(F.struct("bad_out", (-F.col("place")).alias("early")))["early"].alias("early"))
    return items.join(last, "lang").filter(F.col("place") <= -F.col("early")).groupBy("lang", "rule").agg(F.min("cutoff").alias("cutoff"))


def _verdicts(documents, labels, false_rejection, error, certify) -> DataFrame:
    """The measures of every row with ``kept``."""
    measures = materialise(measured(documents), "measures")
    cutoffs = certify(measures, labels, false_rejection, error)
    wide = cutoffs.groupBy("lang").agg(*[
        F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in CUTOFFS
    ]).withColumnRenamed("lang", "stratum")
    wide = materialise(wide, "cutoffs")  # one row per stratum
    rejected = F.lit(False)
    for name, value in scores().items():
        rejected = rejected | F.coalesce(value > F.col(f"cut_{name}"), F.lit(False))
    joined = measures.join(wide, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)


def judged(documents: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION,
           error: float = ERROR) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for every row of
    ``documents (doc_id, text, lang)``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``kept`` is false where a base rule fails or a score lies above the cutoff of the
    row's stratum (``lang``; null is a stratum like any other). Null and empty texts have no words and fail. Repeated
    rows are judged alike, a null ``doc_id`` is judged but never meets a label, other columns are not read. Without
    labels only the base rules apply; an empty table gives no rows.
    """
    return _verdicts(documents, labels, false_rejection, error, certified_cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def accepted(documents: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION,
             error: float = ERROR) -> DataFrame:
    """The rows of ``documents`` that the base rules and jointly certified cutoffs keep, with all their columns."""
    good = _verdicts(documents, labels, false_rejection, error, jointly_certified_cutoffs).filter("kept").select(
        F.col("doc_id").alias("good_id"), F.col("text_hash").alias("good_hash")).distinct()
    return documents.join(good, documents["doc_id"].eqNullSafe(good["good_id"]) & (
        F.xxhash64(documents["text"]) == good["good_hash"]), "left_semi")
