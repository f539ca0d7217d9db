"""Ranked lexical search by the Best Position Algorithm over impact lists, whole and exact.

Documents are indexed in segments, one after the other as a task reads them. In a segment each query term has an
impact list (documents by descending impact) and each document its postings with their positions in those lists.
For one item all lists of its terms are read in parallel from the top. A document that turns up is scored at once
by direct access to its postings, which marks its positions in all lists as seen. The best position of a list is the
end of its seen head, however it came to be seen; a document not seen yet stands behind it in every list, so the sum
of the impacts there bounds its score. Reading stops once that bound is strictly below the item's tenth score:
documents that only tie with it are still looked at, since ties go by id. The tenth score is carried on from segment to
segment of a task, so later ones stop sooner.

Two passes over the documents: one keeps the term counts of query terms (from which the number of documents, their length
and the document frequencies follow), one searches. Nothing is shuffled but ten rows of each item and task. The items are
taken in blocks of ``BLOCK_BYTES`` of text, which is what a task and the driver hold of them at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinframe.llm.words import as_text, by_bytes, owners, split_words
from twinframe.session import materialise

TOP = 10
BLOCK_BYTES = 2 << 20
SEGMENT_DOCS = 1 << 15
SEGMENT_POSTINGS = 2 << 20
FIRST_STEP = 16
FACTOR_BITS = 20  # an impact before its weight is below 10 ** 6

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Bytes of terms stay (A-Z lower-cased), all others become blanks.
TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms of each text: ``offsets`` (one more than texts) into the flat array of all terms."""
    _, ends, data = texts.cast(pa.string()).buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    turned = (memoryview(data)[ends[0]:ends[-1]].tobytes() if data else b"").translate(TERM_BYTES)
    return split_words(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(turned)]))


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Terms of each text, and per text the numbers of vocabulary terms in it with their counts."""
    offsets, words = terms_of(texts)
    coded = words.dictionary_encode()
    numbers = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1), np.int64)
    of_word = numbers[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
    known = of_word >= 0
    width = max(len(vocabulary), 1)
    keys, counts = np.unique(owners(offsets)[known] * width + of_word[known], return_counts=True)
    ends = np.searchsorted(keys, np.arange(len(texts) + 1) * width).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % width, counts)]
    return np.diff(offsets), *lists


class Segment:
    """Impact lists of some documents, and their postings by document. Documents are numbered in the order of ids."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray,
                 n_terms: int, documents: int, total: int):
        order = np.asarray(pc.array_sort_indices(ids, null_placement="at_end")).astype(np.int64)
        self.ids = ids.take(pa.array(order))
        sizes = np.diff(offsets)[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(offsets[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, counts = terms[at], counts[at].astype(np.int64)
        self.docs = np.repeat(np.arange(len(ids)), sizes)
        longer = 25 + (75 * lengths[order].astype(np.int64) * documents) // max(total, 1)
        self.factors = (1_000_000_000 * counts) // (1000 * counts + 8 * longer[self.docs])
        by_impact = np.argsort((self.terms.astype(np.int64) << FACTOR_BITS) - self.factors, kind="stable")
        self.lists = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=n_terms))))
        self.listed = by_impact
        self.places = np.empty(len(by_impact), np.int64)  # of each posting in its list, from 0
        self.places[by_impact] = np.arange(len(by_impact)) - self.lists[self.terms[by_impact]]
        self.slots = np.full(n_terms, -1, np.int64)

    def direct(self, docs: np.ndarray, weights: np.ndarray, bases: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The scores of documents by their own postings; their positions in the lists are marked as seen."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1])
        slots = self.slots[self.terms[at]]
        used = slots >= 0
        upto = np.concatenate(([0], np.cumsum(used)))
        at, slots = at[used], slots[used]
        seen[bases[slots] + self.places[at]] = True
        sums = np.concatenate(([0], np.cumsum(weights[slots] * self.factors[at])))
        return sums[upto[ends]] - sums[upto[ends - sizes]]

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """``(score, document)`` of the best documents with a score of ``floor`` at least, and how many were scored."""
        sizes = self.lists[terms + 1] - self.lists[terms]
        there = (sizes > 0) & (weights > 0)
        terms, weights, sizes = terms[there], weights[there], sizes[there]
        if not len(terms):
            return [], 0
        self.slots[terms] = np.arange(len(terms))
        bases = np.concatenate(([0], np.cumsum(sizes)))
        seen = np.zeros(bases[-1], bool)
        met = np.zeros(len(self.ids), bool)
        head = np.zeros(len(terms), np.int64)  # positions below are seen: the best positions
        scores = docs = np.zeros(0, np.int64)
        depth, step, scored = 0, FIRST_STEP, 0
        while True:
            reads = [self.listed[s + depth:s + min(depth + step, n)] for s, n in zip(self.lists[terms], sizes) if depth < n]
            new = np.unique(self.docs[np.concatenate(reads)])
            new = new[~met[new]]
            if len(new):
                met[new] = True
                scored += len(new)
                scores = np.concatenate((scores, self.direct(new, weights, bases, seen)))
                docs = np.concatenate((docs, new))
                good = scores >= floor
                scores, docs = scores[good], docs[good]
                order = np.lexsort((docs, -scores))[:top]
                scores, docs = scores[order], docs[order]
                if len(scores) == top:
                    floor = max(floor, int(scores[-1]))
            bound = 0
            for k, size in enumerate(sizes):
                rest = seen[bases[k] + head[k]:bases[k + 1]]
                if len(rest):
                    unseen = int(np.argmin(rest))
                    head[k] += len(rest) if rest[unseen] else unseen
                if head[k] < size:
                    bound += int(weights[k] * self.factors[self.listed[self.lists[terms[k]] + head[k]]])
            if bound < floor:
                break
            depth, step = depth + step, step * 2
        self.slots[terms] = -1
        return list(zip(scores.tolist(), docs.tolist())), scored


def _weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def _searched(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, documents: int, total: int,
              top: int) -> DataFrame:
    """``item_no, doc_id, score``: the best of each task's documents for each query ``(item_no, terms, weights)``."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def search(batches):
        best: dict[int, list] = {}

        def close(held):
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            lists = pa.concat_arrays([b.column("terms") for b in held])
            counts = pa.concat_arrays([b.column("counts") for b in held]).flatten()
            lengths = np.concatenate([np.asarray(b.column("n_terms")) for b in held])
            offsets = np.asarray(lists.offsets, np.int64)
            segment = Segment(ids, lengths, offsets - offsets[0], np.asarray(lists.flatten()), np.asarray(counts), n_terms, documents, total)
            for number, terms, weights in queries:
                known = best.get(number, [])
                # A score of 0 is no result, so 1 is the least that counts.
                found, _ = segment.best(terms, weights, top, known[-1][0] if len(known) == top else 1)
                if found:
                    ids_found = segment.ids.take(pa.array([d for _, d in found])).to_pylist()
                    both = known + [(s, i) for (s, _), i in zip(found, ids_found)]
                    best[number] = sorted(both, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:top]

        held, postings, rows = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                size = len(piece.column("terms").flatten())
                if held and (rows + piece.num_rows > SEGMENT_DOCS or postings + size > SEGMENT_POSTINGS):
                    close(held)
                    held, postings, rows = [], 0, 0
                held, postings, rows = [*held, piece], postings + size, rows + piece.num_rows
        if held:
            close(held)
        found = [(n, i, s) for n, rows in best.items() for s, i in rows]
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], index_type),
            pa.array([x[2] for x in found], pa.int64())], names=["item_no", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    index_type = to_arrow_type(index.schema["doc_id"].dataType)
    return index.mapInArrow(search, f"item_no long, doc_id {kind}, score long")


def _items(benchmark: DataFrame) -> DataFrame:
    def split(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                offsets, words = terms_of(as_text(batch.column("text")))
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_no"), batch.column("item_id"), batch.column("block"),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words)], names=["item_no", "item_id", "block", "words"])

    rows = materialise(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    numbered = rows.withColumn("item_no", F.monotonically_increasing_id()).withColumn(
        "block", F.pmod(F.xxhash64("item_id", "text"), F.lit(size // BLOCK_BYTES + 1)).cast("int"))
    kind = rows.schema["item_id"].dataType.simpleString()
    source = numbered.select("item_no", "item_id", "block", "text")
    return materialise(source.mapInArrow(split, f"item_no long, item_id {kind}, block int, words array<string>"), "item_terms")


def ranked_documents(documents: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each row of ``benchmark (item_id, text)`` among
    ``documents (doc_id, text)``.

    Terms are the runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A score above 0 is needed;
    equal scores go by ascending ``doc_id``, null last. Null and empty texts have no terms: such documents count
    nowhere, such items have no rows. Documents that repeat are each a document; items equal in id and text are one
    item, and different texts under one ``item_id`` are ranked apart. Empty tables give no rows. Other columns are not
    read.
    """
    items = _items(benchmark)
    blocks = [r[0] for r in items.select("block").distinct().orderBy("block").collect()]
    kind = documents.schema["doc_id"].dataType.simpleString()
    parts = []
    for block in blocks:
        rows = [(r.item_no, r["words"]) for r in items.filter(F.col("block") == block).select("item_no", "words").collect()]
        vocabulary = pa.array(sorted({w for _, ws in rows for w in ws}), pa.string())

        def count(batches, vocabulary=vocabulary):
            for whole in batches:
                for batch in by_bytes(whole):
                    lengths, terms, counts = counted(as_text(batch.column("text")), vocabulary)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(lengths, pa.int64()), terms, counts], names=["doc_id", "n_terms", "terms", "counts"])

        index = materialise(documents.select("doc_id", "text").mapInArrow(
            count, f"doc_id {kind}, n_terms long, terms array<int>, counts array<int>").filter("n_terms > 0"), "index")
        n, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        having = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        number = {w: k for k, w in enumerate(vocabulary.to_pylist())}
        queries = []
        for item_no, words in rows:
            own: dict[int, int] = {}
            for w in words:
                own[number[w]] = own.get(number[w], 0) + 1
            terms = np.array(sorted(own), np.int64)
            weights = np.array([own[t] * _weight(n, having.get(t, 0)) for t in terms.tolist()], np.int64)
            queries.append((item_no, terms, weights))
        parts.append(materialise(_searched(index.filter(F.size("terms") > 0), queries, max(len(vocabulary), 1), n, total, top), "found"))
    if not parts:
        kind_item = benchmark.schema["item_id"].dataType.simpleString()
        return documents.sparkSession.createDataFrame([], f"item_id {kind_item}, rank int, doc_id {kind}, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(items.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
