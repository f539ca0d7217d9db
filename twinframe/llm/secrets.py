"""Secrets in texts, also inside nested encodings, with spans in the source text.

A worklist starts with the text itself. Each layer is scanned with the plain patterns and then unwrapped: percent
escapes and Unicode escapes are decoded in place, and base64 runs, also over several lines, that hold text (UTF-8 or
UTF-16, also with control characters), or gzip or zlib data in any number of layers that holds text, are replaced by
what they hold. Each way to read the runs gives a layer of its own. Every unwrapped layer joins the worklist with a map of its characters to the layer it
came from, until nothing new appears. A layer that was seen before in the same text is not taken up again, which ends
cycles such as data that decompresses to itself.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from twinframe.llm.intervals import Cover
from twinframe.llm.offsets import Rewritten
from twinframe.llm.words import as_text, by_bytes

KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Data that inflates to more is not unwrapped: memory stays bounded against decompression bombs.
LARGEST_LAYER = 32 << 20
SHORTEST_BASE64 = 16

_NAMES = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) + end
    for name, end in (("password", ""), ("passwd", ""), ("secret", ""), ("token", ""), ("api", "_?[kK][eE][yY]"))
)
ASSIGN = re.compile(rf"""(?:{_NAMES})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f](?<![0-9a-f][0-9a-f])[0-9a-f]{23,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})+")
ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uxU]([0-9A-Fa-f]+))")
BASE64 = re.compile(rf"[A-Za-z0-9+/_-](?<![A-Za-z0-9+/_-][A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST_BASE64 - 1},}}={{0,2}}")
# Lines of base64 with single breaks between them; a further line may be indented.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST_BASE64},}}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={{0,2}}")
WRAPPED_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
UNPRINTABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what stands in ``text`` unencoded, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _one_stream(data: bytes, room: int) -> tuple[bytes, bytes, bool] | None:
    """What the first gzip or zlib stream holds (of a cut one what is there), the bytes behind it, and whether it holds more."""
    inflate = zlib.decompressobj(wbits=47)
    try:
        out = inflate.decompress(data, room)
    except zlib.error:
        return None
    return out, inflate.unused_data, bool(inflate.unconsumed_tail)


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0)


def _inflated(data: bytes) -> bytes | None:
    """``data`` after all layers of compression; none for what ends in itself or grows too large."""
    seen = set()
    while _compressed(data):
        mark = hashlib.sha256(data).digest()
        if mark in seen:
            return None
        seen.add(mark)
        parts, rest, room = [], data, LARGEST_LAYER
        while _compressed(rest) and (stream := _one_stream(rest, room + 1)):  # gzip members follow each other
            out, rest, more = stream
            room -= len(out)
            if more or room < 0:
                return None
            parts.append(out)
        if not parts:
            break
        data = b"".join(parts)
    return data


def _readings(data: bytes) -> list[str | None]:
    """What bytes say: printable text, text with control characters, UTF-16 text; none where they do not say it."""
    inflated = _inflated(data)
    if not inflated:
        return [None] * 3
    try:
        text = inflated.decode()
    except UnicodeDecodeError:
        text = None if inflated is data else inflated.decode(errors="replace")
    wide = None
    marked = inflated[:2] in (b"\xff\xfe", b"\xfe\xff")
    if marked or b"\0" in inflated:
        big = inflated[:2] == b"\xfe\xff" or not marked and inflated[::2].count(0) > inflated[1::2].count(0)
        wide = inflated[2 * marked:].decode("utf-16-be" if big else "utf-16-le", "replace")
    return [None if text is None or UNPRINTABLE.search(text) else text, text, wide]


def _from_base64(run: str) -> list[str | None]:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return [None] * 3
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return [None] * 3
    return _readings(data)


def _from_percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _from_escapes(run: str) -> str | None:
    points = [int(m[1] or m[2], 16) for m in ONE_ESCAPE.finditer(run)]
    if max(points) > 0x10FFFF:
        return None
    joined = "".join(map(chr, points))
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _wrapped_runs(text: str) -> list[tuple[list[int], list[int]]]:
    """Starts and ends of the lines of base64 runs that go on over line breaks: equal lines and a last one, at most as long."""
    runs = []
    for m in WRAPPED.finditer(text):
        lines = [line.span() for line in WRAPPED_LINE.finditer(text, *m.span())]
        sizes = [len(text[s:e].rstrip("=")) if e == m.end() else e - s for s, e in lines]
        first = 0
        while first < len(lines):
            last = first
            while last + 1 < len(lines) and sizes[last] == sizes[first] >= sizes[last + 1]:
                last += 1
            if last > first and sizes[first] >= SHORTEST_BASE64:
                runs.append(lines[first:last + 1])
            first = last + 1
    return runs


def _base64_edits(text: str):
    """Edits for each way to read the base64 runs: single lines, wrapped runs, these without a last line that may be prose."""
    runs = [[m.span()] for m in BASE64.finditer(text)]
    wrapped = _wrapped_runs(text)
    short = [run[:-1] for run in wrapped if len(run) > 2]
    for group in (runs, wrapped, short):
        read = [(run[0][0], run[-1][1], _from_base64("".join(text[s:e] for s, e in run))) for run in group]
        clean, raw, wide = ([(s, e, texts[k]) for s, e, texts in read if texts[k]] for k in range(3))
        yield clean
        if raw != clean:
            yield raw
        if wide:
            yield wide


def unwrapped(text: str):
    """The layers directly below ``text``: one for each encoding that occurs in it."""
    decoders = []
    if "%" in text:
        decoders.append((PERCENT, _from_percent))
    if "\\" in text:
        decoders.append((ESCAPE, _from_escapes))
    for pattern, decode in decoders:
        edits = [(*m.span(), new) for m in pattern.finditer(text) if (new := decode(m[0])) is not None]
        if edits:
            yield Rewritten(text, edits)
    for edits in _base64_edits(text):
        if edits:
            yield Rewritten(text, edits)


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans with those of the layers below that lie in no span of their kind found before."""
    plain = plain_spans(text)
    found = list(plain)
    covers = [Cover() for _ in KINDS]
    for start, kind, end in plain:
        covers[kind].add(start, end)
    work = deque([(text, ())])
    seen = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}
    while work:
        layer, steps = work.popleft()
        for below in unwrapped(layer):
            mark = hashlib.sha256(below.text.encode("utf-8", "surrogatepass")).digest()
            if mark in seen:
                continue
            seen.add(mark)
            path = (*steps, below)
            for start, kind, end in plain_spans(below.text):
                for step in reversed(path):
                    start, end = step.source(start, end)
                if not covers[kind].holds(start, end):
                    found.append((start, kind, end))
                    covers[kind].add(start, end)
            work.append((below.text, path))
    return plain, sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``documents (doc_id, text)``.

    The counts and the digest are those of the plain patterns, ``spans`` holds those of decoded layers too, as
    ``kind:start:end`` in code points of the source, by start and kind. Null and empty texts have no spans. Repeated
    rows are judged each for itself, other columns are not read, an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text")

    def scan(batches):
        for whole in batches:
            for batch in by_bytes(whole):
                counts, digests, spans = [], [], []
                for text in as_text(batch.column("text")).to_pylist():
                    plain, found = find_spans(text)
                    counts.append([sum(k == kind for _, k, _ in plain) for kind in range(len(KINDS))])
                    digests.append(hashlib.sha256(joined(plain).encode()).hexdigest())
                    spans.append(joined(found))
                out = {"doc_id": batch.column("doc_id")}
                out |= {f"n_{kind}": pa.array([c[k] for c in counts], pa.int64()) for k, kind in enumerate(KINDS)}
                yield pa.RecordBatch.from_pydict(out | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "".join(f"n_{k} long, " for k in KINDS)
    return rows.mapInArrow(scan, f"doc_id {kind}, {counts}base_sha256 string, spans string")
