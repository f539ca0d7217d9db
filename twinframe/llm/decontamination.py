"""Benchmark passages in documents: a prefix-filtered join of item windows with whole texts. DataFrame functions only.

A window is ``width`` consecutive words of an item (a shorter item is one window), and its tokens are its word shingles
of ``shingle`` words. Whole containment needs every token of a window in the document, so one necessary token is
enough to find candidates: the shingles are ordered by their number in all documents, and each window is joined by its
rarest one only. That token's place in the window fixes where the window would start in the document: the position
bound drops starts before the text, the length bound windows that would end behind it. What is left is verified word
for word in the document itself.

Joins are left to the planner: the window tables are written first, so their true size decides whether they are
broadcast (under the session's limit) or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.session import materialise

WIDTH = 10
SHINGLE = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def shingle_hashes(words: Column, sizes: list[int]) -> Column:
    """``(at, token)`` for each shingle of the given sizes; ``at`` counts words from 0."""

    def of_size(size):
        def one(w):
            starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
            token = lambda i: F.xxhash64(F.lit(size), *[F.get(w, i + k) for k in range(size)])
            return F.transform(starts, lambda i: F.struct(i.alias("at"), token(i).alias("token")))

        return one

    return bound(words, lambda w: F.concat(*[of_size(size)(w) for size in sizes]))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """``item_id, words``: the distinct windows of each item."""
    words = benchmark.select(F.col("item_id"), item_words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("words")).distinct()


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["text_hash"].eqNullSafe(b["text_hash"])


def _found(documents: DataFrame, benchmark: DataFrame, width: int, shingle: int) -> DataFrame:
    """``hit_id, hit_hash, n_hit, items`` of the texts that hold a window."""
    per_item = item_windows(benchmark.filter("item_id is not null"), width).select(
        "item_id", "words", F.xxhash64("words").alias("hash"))
    per_item = materialise(per_item, "windows")
    distinct = per_item.select("hash", "words").distinct()
    lengths = [r[0] for r in distinct.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()]
    sizes = sorted(lengths) or [shingle]  # at most ``shingle`` different values

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("words"))
    tokens = rows.select(
        "doc_id", "text_hash", F.size("words").alias("n_words"), F.explode(shingle_hashes(F.col("words"), sizes)).alias("t")
    ).select("doc_id", "text_hash", "n_words", "t.at", "t.token")

    # Rarity: how often each shingle of a window stands in all documents.
    own_size = F.least(F.size("words"), F.lit(shingle))
    in_window = distinct.select(
        "hash", "words", F.explode(shingle_hashes(F.col("words"), sizes)).alias("t"), own_size.alias("own")
    ).select("hash", "words", "t.at", "t.token", "own")
    full = F.size("words") - F.col("own")
    in_window = materialise(in_window.filter(F.col("at") <= full), "tokens")
    wanted = materialise(in_window.select("token").distinct(), "wanted")
    rarity = materialise(tokens.select("token").join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("met")), "rarity")
    ordered = in_window.join(rarity, "token")
    # A window with a shingle that no document holds occurs nowhere, so it needs all of its shingles here.
    complete = ordered.groupBy("hash").agg(
        F.count(F.lit(1)).alias("there"), F.min(F.struct("met", "at", "token")).alias("rarest"), F.first("words").alias("words")
    ).filter(F.col("there") >= F.size("words") - F.least(F.size("words"), F.lit(shingle)) + 1)
    prefixes = materialise(complete.select(
        "hash", "words", F.col("rarest.at").alias("place"), F.col("rarest.token").alias("token"),
        F.size("words").alias("length")), "prefixes")

    start = F.col("at") - F.col("place")
    candidates = tokens.join(prefixes.select("token", "place", "length", "hash"), "token").filter(
        (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    ).select("doc_id", "text_hash", "hash", start.alias("start")).distinct()
    candidates = materialise(candidates, "candidates")
    suspects = materialise(candidates.select("doc_id", "text_hash").distinct(), "suspects")
    texts = rows.join(suspects, _same(rows, suspects), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    # A text and what it may hold: bounded by its own length, as a window starts at a word at most once.
    proposed = candidates.join(prefixes.select("hash", F.col("words").alias("window")), "hash").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", "window", "hash")).alias("proposed"))
    hits = texts.join(proposed, _same(texts, proposed)).select(
        texts["doc_id"], texts["text_hash"],
        bound(F.col("words"), lambda w: F.filter(
            "proposed", lambda p: F.slice(w, p["start"] + 1, F.size(p["window"])) == p["window"])).alias("found"),
    ).filter(F.size("found") > 0)
    hits = materialise(hits, "hits")

    covered = F.flatten(F.transform("found", lambda p: F.sequence(p["start"], p["start"] + F.size(p["window"]) - 1)))
    n_hit = hits.select("doc_id", "text_hash", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    found = hits.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("found", lambda p: p["hash"]))).alias("hash"))
    items = found.join(per_item.select("hash", "item_id"), "hash").groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return materialise(n_hit.join(items, _same(n_hit, items)).select(
        n_hit["doc_id"].alias("hit_id"), n_hit["text_hash"].alias("hit_hash"), "n_hit", "items"), "result")


def contaminated_words(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                       shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``documents (doc_id, text)``.

    ``n_hit`` counts the words inside any occurrence of an item window, ``n_items`` the items with one, and the digest
    is over their ids, sorted as strings and joined by commas. Null and empty texts have no words; items without words
    have no window. Rows that repeat a ``doc_id`` are told apart by their text, equal rows share one result, and a null
    ``doc_id`` is a value like any other. Empty tables give no rows, or no hits. Only ``doc_id``, ``item_id`` and
    ``text`` are read. ``item_id`` null never counts as an item.
    """
    result = _found(documents, benchmark, width, shingle)
    every = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(
        result, every["doc_id"].eqNullSafe(result["hit_id"]) & every["text_hash"].eqNullSafe(result["hit_hash"]), "left")
    item_list = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(item_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(item_list, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def uncontaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                   shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that hold no window, with all their columns."""
    result = _found(documents, benchmark, width, shingle)
    return documents.join(result, documents["doc_id"].eqNullSafe(result["hit_id"]) & (
        F.xxhash64(documents["text"]) == result["hit_hash"]), "left_anti")
