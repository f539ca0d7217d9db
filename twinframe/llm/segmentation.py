"""N-best segmentations of texts over a SentencePiece vocabulary, and decoding.

The pieces that match a text form a lattice. The forward Viterbi pass gives the best score of every prefix, which is an
exact heuristic for an A* search that runs backwards from the end: the agenda always yields the next best whole
segmentation.

No piece reaches over the start of a word (this is checked when a vocabulary is read), so the lattice of a text is a
chain of small lattices, one per chunk (blanks and the word behind them). Scores add up over the chain. Hence only the
chunks with the smallest loss of their second best segmentation can differ from the best one in the first ``n``
results: ``n - 1`` of them are enough. Their own A* searches are merged best first; the result is that of the search
over the whole text. Forward scores and the losses of all chunks are computed for many distinct chunks at once, once
per task and chunk.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from twinframe.llm.words import STEP, as_text, by_bytes, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 3
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
SHORT = 24  # longer chunks are searched one by one
AT_ONCE = 1 << 14
REMEMBERED = 500_000
#: Scores are held in steps of this size (a power of two, finer than the 32-bit scores of model files from 0.5 on), so
#: sums come out the same in any order, and equal scores are equal.
SCORE_STEP = 2.0 ** -24
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Vocabulary:
    """Pieces with ids and scores. A character without a piece of its own is written as the pieces of its bytes, at a
    score below all others."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece reaches over the start of a word")
        self.pieces = {p: (i, round(score / SCORE_STEP) * SCORE_STEP) for p, (i, score) in pieces.items()}
        self.byte_ids = byte_ids
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        self.bytes_of = {i: p.replace(BLANK, " ").encode() for p, (i, _) in pieces.items()}
        self.bytes_of |= {i: bytes([k]) for k, i in enumerate(byte_ids)}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in usable}
        return cls(pieces, [i for i in ids if model.is_byte(i)])

    def tables(self):
        """For each length, sorted hashes of the pieces with ids and scores."""
        if not hasattr(self, "_tables"):
            self._tables = {}
            for length in range(1, self.longest + 1):
                own = [p for p in self.pieces if len(p) == length]
                hashes = _prefix_hashes(_codes(own, length))[:, -1] if own else np.zeros(0, np.uint64)
                order = np.argsort(hashes)
                ids = np.array([self.pieces[p][0] for p in own], np.int64)[order]
                scores = np.array([self.pieces[p][1] for p in own])[order]
                if len(np.unique(hashes)) != len(own):
                    raise ValueError("two pieces share a hash")
                self._tables[length] = hashes[order], ids, scores
        return self._tables

    def bytes_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (BLANK if char == LITERAL else char).encode()]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        return text[1:]  # the blank before the first word

    def spells(self, chunk: str, ids: np.ndarray) -> bool:
        text = chunk.replace(BLANK, " ").replace(LITERAL, BLANK)
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())) == text.encode()


#: Stands for a blank sign that the text itself holds; no text holds this code point.
LITERAL = "\ud800"


def _codes(chunks: list[str], length: int) -> np.ndarray:
    data = "".join(chunks).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4").reshape(len(chunks), length)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * STEP + mixed(codes[:, k].astype(np.uint64) + np.uint64(1))
    return out


def _edges(vocabulary: Vocabulary, chunks: list[str], length: int):
    """``(ids, scores)`` by end and piece length; characters without a piece have the negative of their code."""
    codes = _codes(chunks, length)
    hashes = _prefix_hashes(codes)
    tables = vocabulary.tables()
    powers = [np.uint64(pow(int(STEP), k, 1 << 64)) for k in range(length + 1)]
    ids, scores = {}, {}
    with np.errstate(over="ignore"):
        for size in range(1, min(vocabulary.longest, length) + 1):
            known, own_ids, own_scores = tables[size]
            wanted = hashes[:, size:] - hashes[:, : length + 1 - size] * powers[size]
            at = np.searchsorted(known, wanted)
            if len(known):
                at[at == len(known)] = 0
                found = known[at] == wanted
            else:
                found = np.zeros(wanted.shape, bool)
            score = np.where(found, own_scores[at] if len(known) else 0.0, -np.inf)
            piece = np.where(found, own_ids[at] if len(known) else 0, 0)
            if size == 1:
                score = np.where(found, score, vocabulary.unknown)
                piece = np.where(found, piece, -1 - codes.astype(np.int64))
            for start in range(length + 1 - size):
                ids[start + size, size], scores[start + size, size] = piece[:, start], score[:, start]
    return ids, scores


def analysed(vocabulary: Vocabulary, chunks: list[str]):
    """Best score, loss of the second best segmentation (infinite if there is none), number of best pieces of each
    chunk, and the best pieces themselves, one chunk's after the other's.

    Of equal scores the longer last piece wins.
    """
    best, loss = np.zeros(len(chunks)), np.full(len(chunks), np.inf)
    counts, order, flat = np.zeros(len(chunks), np.int64), [], []
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    by_length = np.argsort(lengths, kind="stable")
    for members in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
        length = int(lengths[members[0]])
        for at in range(0, len(members), AT_ONCE):
            part = members[at:at + AT_ONCE]
            search = _analysed if length <= SHORT else _searched
            best[part], loss[part], counts[part], ids = search(vocabulary, [chunks[k] for k in part], length)
            order.append(part)
            flat.append(ids)
    ids, order = np.concatenate(flat), np.concatenate(order)
    starts = np.empty(len(chunks), np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return best, loss, counts, ids[_ranges(starts, counts)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``starts[k] ... starts[k] + counts[k] - 1`` of every ``k``."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _searched(vocabulary, chunks, _):
    found = [n_best(vocabulary, c, 2) for c in chunks]
    loss = [r[0][0] - r[1][0] if len(r) > 1 else np.inf for r in found]
    ids = [r[0][1] for r in found]
    return [r[0][0] for r in found], loss, [len(i) for i in ids], np.concatenate(ids)


def _analysed(vocabulary, chunks, length):
    rows = len(chunks)
    ids, scores = _edges(vocabulary, chunks, length)
    longest = min(vocabulary.longest, length)
    forward = np.full((length + 1, rows), -np.inf)
    forward[0] = 0.0
    step = np.zeros((length + 1, rows), np.int8)
    for end in range(1, length + 1):
        for size in range(min(longest, end), 0, -1):
            value = forward[end - size] + scores[end, size]
            np.putmask(step[end], value > forward[end], size)
            np.maximum(forward[end], value, out=forward[end])
    backward = np.full((length + 1, rows), -np.inf)
    backward[length] = 0.0
    for start in range(length - 1, -1, -1):
        for size in range(1, min(longest, length - start) + 1):
            np.maximum(backward[start], scores[start + size, size] + backward[start + size], out=backward[start])
    # Size of the best path's piece that ends at each place, 0 off the path.
    taken = np.zeros((length + 1, rows), np.int8)
    on = np.zeros((length + 1, rows), bool)
    on[length] = True
    for end in range(length, 0, -1):
        taken[end] = step[end] * on[end]
        for size in range(1, min(longest, end) + 1):
            on[end - size] |= taken[end] == size
    chosen = np.zeros((rows, length), np.int64)
    second = np.full(rows, -np.inf)
    for (end, size), piece in ids.items():
        best_here = taken[end] == size
        np.copyto(chosen[:, end - size], piece, where=best_here)
        through = forward[end - size] + scores[end, size] + backward[end]
        np.putmask(through, best_here, -np.inf)
        np.maximum(second, through, out=second)
    used = on[:length].T
    flat, counts = chosen[used], used.sum(axis=1)
    ascii_byte = (flat < 0) & (flat >= -128)
    flat[ascii_byte] = np.array(vocabulary.byte_ids)[-1 - flat[ascii_byte]]
    if (flat < 0).any():
        parts = [_with_bytes(vocabulary, part) for part in np.split(flat, np.cumsum(counts)[:-1])]
        flat, counts = np.concatenate(parts), np.array([len(x) for x in parts])
    return forward[length], forward[length] - second, counts, flat


def _with_bytes(vocabulary, ids):
    if (ids >= 0).all():
        return ids
    parts = ([i] if i >= 0 else vocabulary.bytes_ids(chr(-1 - i)) for i in ids.tolist())
    return np.array(list(chain.from_iterable(parts)), np.int64)


def n_best(vocabulary: Vocabulary, chunk: str, n: int) -> list[tuple[float, np.ndarray]]:
    """The ``n`` best segmentations: forward Viterbi scores, then A* backwards with them as the heuristic.

    Of equal estimates the search goes on where it is nearest to the start of the text. So of equal scores the longer
    last piece comes first, as in ``analysed``.
    """
    size, pieces = len(chunk), vocabulary.pieces
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    forward = [0.0] + [-np.inf] * size
    for end in range(1, size + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            found = pieces.get(chunk[start:end])
            if found is None and end - start == 1:
                found = -1 - ord(chunk[start]), vocabulary.unknown
            if found is not None:
                into[end].append((start, *found))
                forward[end] = max(forward[end], forward[start] + found[1])
    agenda = [(-forward[size], size, 0, 0.0, None)]
    pushed, results = 0, []
    while agenda and len(results) < n:
        _, at, _, behind, path = heapq.heappop(agenda)
        if at == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            ids = np.array(ids, np.int64)
            results.append((behind, _with_bytes(vocabulary, ids)))
            continue
        for start, piece, score in into[at]:
            pushed += 1
            heapq.heappush(agenda, (-(forward[start] + score + behind), start, pushed, behind + score, (piece, path)))
    return results


def chunks_of(text: str) -> list[str]:
    """Blanks and the word behind them; a blank is put before the text."""
    if not text:
        return []
    return CHUNK.findall(BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK))


class Column:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype), 0

    def extend(self, values):
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size:need] = values
        self.size = need


class Encoder:
    """Segmentations of many texts, with a memory of the chunks met before (cleared when it has grown large)."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self.clear()

    def clear(self):
        self.places: dict[str, int] = {}
        self.names: list[str] = []
        self.searched: dict[int, list] = {}
        self.best, self.loss = Column(np.float64), Column(np.float64)
        self.starts, self.counts, self.ids = Column(np.int64), Column(np.int32), Column(np.int32)

    def _learn(self, chunks):
        new = [c for c in dict.fromkeys(chunks) if c not in self.places]
        if new:
            best, loss, counts, ids = analysed(self.vocabulary, new)
            self.places.update(zip(new, range(len(self.names), len(self.names) + len(new))))
            self.names += new
            self.starts.extend(np.cumsum(counts) - counts + self.ids.size)
            for column, values in ((self.best, best), (self.loss, loss), (self.counts, counts), (self.ids, ids)):
                column.extend(values)

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of all texts as places in the memory, and where each text's chunks begin."""
        simple = np.asarray(pc.invert(pc.match_substring_regex(texts, f"^$|^ |  | $|{BLANK}")))
        split = pc.split_pattern(texts, " ")
        words, offsets = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        distinct = [BLANK + w for w in coded.dictionary.to_pylist()]
        others = {k: chunks_of(texts[k].as_py()) for k in np.flatnonzero(~simple).tolist()}
        if len(self.places) > REMEMBERED:
            self.clear()
        self._learn(chain(distinct, *others.values()))
        places = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
        flat = places[np.asarray(coded.indices)] if len(words) else places
        if not others:
            return flat, offsets
        parts = [
            np.array([self.places[c] for c in others[k]], np.int64) if k in others else flat[offsets[k]:offsets[k + 1]]
            for k in range(len(texts))
        ]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _search(self, place: int):
        if place not in self.searched:
            self.searched[place] = n_best(self.vocabulary, self.names[place], self.n)
        return self.searched[place]

    def encode(self, texts: pa.Array):
        """For each text its results in order: ``(score, ids, changes)``, where ``changes`` are the pieces that replace
        those of the best result, by chunk. An empty text has one empty result."""
        places, offsets = self._places(texts)
        counts = self.counts.data[places].astype(np.int64)
        ids = self.ids.data[_ranges(self.starts.data[places], counts)]
        ends = np.cumsum(counts)
        begins = np.concatenate(([0], ends))
        losses, scores = self.loss.data[places], self.best.data[places]
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            base = begins[s]
            best = ids[base:begins[e]]
            total = float(scores[s:e].sum())
            results = [(total, best, ())]
            merged = [(0.0, ())]
            for k in self._least(losses[s:e], min(self.n - 1, e - s)).tolist():
                if np.isfinite(losses[s + k]):
                    own = self._search(int(places[s + k]))
                    merged = heapq.nsmallest(self.n, (
                        (lost + own[0][0] - score, (*chosen, (k, pieces)) if rank else chosen)
                        for lost, chosen in merged for rank, (score, pieces) in enumerate(own)), key=lambda x: x[0])
            for lost, chosen in merged:
                if chosen:
                    parts, at = [], 0
                    for k, pieces in sorted(chosen, key=lambda x: x[0]):
                        parts += [best[at:begins[s + k] - base], pieces]
                        at = begins[s + k + 1] - base
                    changes = tuple((self.names[places[s + k]], pieces) for k, pieces in chosen)
                    results.append((total - lost, np.concatenate([*parts, best[at:]]), changes))
            yield results

    @staticmethod
    def _least(losses, count):
        if count <= 0:
            return np.zeros(0, np.int64)
        limit = np.partition(losses, count - 1)[count - 1]
        under, at = np.flatnonzero(losses < limit), np.flatnonzero(losses == limit)
        near = np.concatenate((under, at[: count - len(under)]))
        return near[np.lexsort((near, losses[near]))]


def _shared(documents: DataFrame, model: str):
    """The contents of the vocabulary file, about a megabyte, for all tasks."""
    vocabulary = Vocabulary.read(model)
    return documents.sparkSession.sparkContext.broadcast({"pieces": vocabulary.pieces, "byte_ids": vocabulary.byte_ids})


def _encoder(shared, n: int) -> Encoder:
    """A worker keeps a broadcast value for all its tasks, and with it the encoder and what it remembers."""
    value = shared.value
    if ("encoder", n) not in value:
        value["encoder", n] = Encoder(Vocabulary(value["pieces"], value["byte_ids"]), n)
    return value["encoder", n]


def _encoded(documents: DataFrame, model: str, n: int, row, schema: str) -> DataFrame:
    rows = documents.select("doc_id", "text")
    shared = _shared(documents, model)

    def encode(batches):
        encoder = _encoder(shared, n)
        vocabulary = encoder.vocabulary
        for whole in batches:
            for batch in by_bytes(whole):
                texts = as_text(batch.column("text"))
                out, owner = [], []
                for k, (text, results) in enumerate(zip(texts.to_pylist(), encoder.encode(texts))):
                    same = vocabulary.decode(results[0][1].tolist()) == text
                    for rank, (score, ids, changes) in enumerate(results):
                        # The others differ in whole chunks, whose pieces must spell the same.
                        spelled = all(vocabulary.spells(chunk, pieces) for chunk, pieces in changes)
                        owner.append(k)
                        out.append(row(rank + 1, score, ids, same and spelled))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), row.types)] if out else [pa.array([], t) for t in row.types]
                ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *row.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, {schema}")


def _whole(rank, score, ids, same):
    return rank, score, len(ids), ids.astype(np.int32), same


_whole.names = ["rank", "score", "n_pieces", "ids", "round_trip"]
_whole.types = [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]


def _digest(rank, score, ids, same):
    return rank, score, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), same


_digest.names = ["rank", "score", "n_pieces", "ids_sha256", "round_trip"]
_digest.types = [pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]


def segmentations(documents: DataFrame, n: int = BEST, model: str = MODEL) -> DataFrame:
    """``doc_id, rank, score, n_pieces, ids, round_trip``: up to ``n`` segmentations of every row's text, best first.

    A blank is put before a text, blanks are written as the vocabulary's blank sign, everything else stays as it is.
    ``round_trip`` says that decoding ``ids`` gives the text back. Null and empty texts have one segmentation without
    pieces; a text with fewer segmentations than ``n`` has what there is. No segmentation comes twice. Rank 1 is, of equal
    scores, the one with the longer last piece, then the longer one before it; further ranks of equal score come in any
    order, but always the same one. Repeated rows have the same results, other columns are not read, an empty table gives no rows.
    """
    return _encoded(documents, model, n, _whole,
                    "rank int, score double, n_pieces long, ids array<int>, round_trip boolean")


def segmentation_digests(documents: DataFrame, n: int = BEST, model: str = MODEL) -> DataFrame:
    """As ``segmentations``, with ``ids_sha256`` over the ids as little-endian 32-bit numbers."""
    return _encoded(documents, model, n, _digest,
                    "rank int, score double, n_pieces long, ids_sha256 string, round_trip boolean")


def decoded(encodings: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, rank, text`` of ``encodings (doc_id, rank, ids)``; no pieces are the empty text."""
    shared = _shared(encodings, model)
    rows = encodings.select("doc_id", "rank", "ids")

    def decode(batches):
        for b in batches:
            vocabulary = _encoder(shared, 1).vocabulary
            texts = [vocabulary.decode(ids) if ids else "" for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rank"), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"doc_id {kind}, rank int, text string")
