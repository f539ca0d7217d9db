"""WARC archives of pages, and a two-level index of their captures.

Archives: each task writes its rows as gzip members, one per record, straight into the shared folder. Records with a
payload that stands elsewhere too are revisits of the one with the smallest ``page_id``.

Index: captures are sorted by their key (host labels reversed, then path and page), and each sorted part becomes one
index file of compressed blocks of ``BLOCK`` lines. The directory has one row per block: its first key, offset and
length. A lookup finds the index file by binary search over the files' first keys, the block by binary search over the
file's directory, reads just that block, and finds the line in it by binary search; the line says which range of
which archive to read.

Files of failed or repeated attempts of a task are never read: only what the written tables name counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.session import materialise, work_root

BLOCK = 256
LEVEL = 4
FILE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the table has no time of capture
PAGE_URN = "urn:x-page:"
BREAK = b"\r\n"


def _store(folder: str) -> tuple[FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return FileSystem.from_uri(folder)


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ``)`` and the rest of the address; control characters and blanks
    are percent-encoded. An address without a host is its own key, a null one the empty key."""
    if url is None:
        return ""
    clean = quote(url.strip(), safe="!#$%&'()*+,/:;=?@[]~", encoding="utf-8")
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname, parts.port
    except ValueError:
        return clean
    if not host:
        return clean
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")


def _line_safe(url: str | None) -> str:
    return "" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record with an HTTP block; a revisit keeps the HTTP header and leaves the payload out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line_safe(url)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + BREAK * 2 + block + BREAK * 2


def parsed(data: bytes) -> dict:
    """Type, payload length and digest, and the page a revisit refers to. A payload that differs from its digest
    raises."""
    head, _, rest = data.partition(BREAK * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(BREAK * 2)
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda name: fields[name].strip("<>").removeprefix(PAGE_URN) if name in fields else None
    return {
        "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
        "refers_to": int(page("WARC-Refers-To")) if revisit else None,
    }


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """``url_key, page_id, file, offset, length`` of one record per row of ``pages (page_id, url, html)``.

    A null html is an empty payload. Equal payloads of at least ``min_bytes`` bytes are stored once, by the smallest
    page_id (of rows that repeat it, each); rows without page_id revisit it too, and are responses where no row has one.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), digest.alias("digest"))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    twice = pages.filter(long_enough).select("page_id", digest.alias("digest")).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(materialise(twice, "twice"), "digest", "left")

    def write(batches):
        store, base = _store(folder)
        sink = name = None
        for b in batches:
            out: dict[str, list] = {"url_key": [], "page_id": [], "file": [], "offset": [], "length": []}
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")]
            for page_id, url, html, sha, first in zip(*columns):
                if sink is None or at > FILE_BYTES:
                    if sink:
                        sink.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                refers_to = None if first is None or page_id == first else first
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                digest32 = base64.b32encode(bytes.fromhex(sha)).decode()
                data = pack.compress(record(page_id, url, html.encode(), digest32, refers_to)) + pack.flush()
                sink.write(data)
                for column, value in zip(out.values(), (url_key(url), page_id, name, at, len(data))):
                    column.append(value)
                at += len(data)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("url_key", pa.string()), ("page_id", b.schema.field("page_id").type), ("file", pa.string()),
                ("offset", pa.int64()), ("length", pa.int64())]))
        if sink:
            sink.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "digest", "first").mapInArrow(
        write, f"url_key string, page_id {kind}, file string, offset long, length long")


def _order(key: str, page_id) -> tuple:
    return key.encode(), -1 if page_id is None else page_id


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """The directory ``shard, offset, length, first_key, first_page`` of the index files written for ``captures``."""
    keys = [F.col("url_key"), F.col("page_id").asc_nulls_first()]
    ordered = captures.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def write(batches):
        store, base = _store(folder)
        name, at, lines, sink = f"{uuid.uuid4().hex}.idx", 0, [], None
        out: dict[str, list] = {"shard": [], "offset": [], "length": [], "first_key": [], "first_page": []}

        def flush():
            nonlocal at, lines
            text = "\n".join("\t".join("" if v is None else str(v) for v in line) for line in lines)
            data = zlib.compress(text.encode(), LEVEL)
            sink.write(data)
            for column, value in zip(out.values(), (name, at, len(data), lines[0][0], _order(*lines[0][:2])[1])):
                column.append(value)
            at, lines = at + len(data), []

        for b in batches:
            if sink is None and b.num_rows:
                sink = store.open_output_stream(f"{base}/{name}", compression=None)
            for line in zip(*(b.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length"))):
                lines.append(line)
                if len(lines) == block:
                    flush()
        if lines:
            flush()
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pydict(out, pa.schema([
            ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("first_key", pa.string()),
            ("first_page", pa.int64())]))

    return ordered.mapInArrow(write, "shard string, offset long, length long, first_key string, first_page long")


def locate(queries: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """``url_key, page_id, file, offset, length`` of the captures asked for by ``queries (url_key, page_id)``.

    What is not in the index gives no row; a query asked twice, or a capture indexed twice, gives each of its rows.
    """
    starts = directory.groupBy("shard").agg(F.min(F.struct("first_key", "first_page")).alias("s"))
    # One entry per index file: as many as the range partitioning has parts.
    tops = sorted(((r.s.first_key.encode(), r.s.first_page), r.shard) for r in starts.collect())
    kind = queries.schema["page_id"].dataType.simpleString()
    schema = f"url_key string, page_id {kind}, file string, offset long, length long"
    firsts, shards = [t[0] for t in tops], [t[1] for t in tops]

    def assign(batches):
        for b in batches:
            asked = [_order(k, p) for k, p in zip(*(b.column(c).to_pylist() for c in ("url_key", "page_id")))]
            at = [(bisect_left(firsts, q) - 1, bisect_right(firsts, q) - 1) for q in asked]
            rows = [k for k, (low, high) in enumerate(at) for _ in range(max(low, 0), high + 1)]
            names = [shards[i] for low, high in at for i in range(max(low, 0), high + 1)]
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "url_key": part.column("url_key"), "page_id": part.column("page_id"), "shard": pa.array(names, pa.string())})

    asked = queries.select("url_key", "page_id").mapInArrow(assign, f"url_key string, page_id {kind}, shard string")

    def look(key, wanted, blocks):
        blocks = blocks.sort_by("offset").to_pylist()
        starts = [(b["first_key"].encode(), b["first_page"]) for b in blocks]
        out: dict[str, list] = {"url_key": [], "page_id": [], "file": [], "offset": [], "length": []}
        if wanted.num_rows and blocks:
            store, base = _store(folder)
            with store.open_input_file(f"{base}/{key[0].as_py()}") as source:
                queries_in_order = sorted(_order(k, p) for k, p in zip(wanted["url_key"].to_pylist(), wanted["page_id"].to_pylist()))
                opened, lines, keys = -1, [], []
                for q in queries_in_order:
                    # Equal keys may span blocks: from the block before the first start that is not smaller.
                    for k in range(max(0, bisect_left(starts, q) - 1), bisect_right(starts, q)):
                        if k != opened:
                            source.seek(blocks[k]["offset"])
                            text = zlib.decompress(source.read(blocks[k]["length"])).decode()
                            lines = [line.split("\t") for line in text.split("\n")]
                            keys = [_order(x[0], int(x[1]) if x[1] else None) for x in lines]
                            opened = k
                        for x in lines[bisect_left(keys, q):bisect_right(keys, q)]:
                            row = (x[0], int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4]))
                            for column, value in zip(out.values(), row):
                                column.append(value)
        return pa.table(out, pa.schema([
            ("url_key", pa.string()), ("page_id", wanted.schema.field("page_id").type), ("file", pa.string()),
            ("offset", pa.int64()), ("length", pa.int64())]))

    return asked.groupBy("shard").cogroup(directory.groupBy("shard")).applyInArrow(look, schema)


def read_records(located: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the located records, read in file order."""
    near = located.select("page_id", "file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    kind = located.schema["page_id"].dataType.simpleString()

    def read(batches):
        store, base = _store(folder)
        name = source = None
        for b in batches:
            found = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                source.seek(offset)
                found.append(parsed(zlib.decompress(source.read(length), 31)))
            yield pa.RecordBatch.from_pydict({
                "page_id": b.column("page_id"),
                "payload_bytes": pa.array([f["payload_bytes"] for f in found], pa.int64()),
                "payload_digest": pa.array([f["payload_digest"] for f in found], pa.string()),
                "record_type": pa.array([f["record_type"] for f in found], pa.string()),
                "refers_to": pa.array([f["refers_to"] for f in found], b.schema.field("page_id").type),
            })
        if source:
            source.close()

    return near.mapInArrow(
        read, f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages (page_id, url, html)`` to archives and an index, asks the index for every page, and reads each
    record back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null urls have the empty key and null html is an empty payload. Repeated rows have a record each; looked up by the
    same key, each is found once. An empty table writes nothing and gives no rows. Only the three columns are read.
    """
    spark = pages.sparkSession
    folder = f"{work_root(spark)}/warc-{uuid.uuid4().hex}"
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    captures = materialise(write_archives(pages, folder, min_bytes), "captures")
    directory = materialise(build_index(captures, folder), "directory")
    # Asked once per key: repeated rows share a key and come back as the records they have.
    located = materialise(locate(captures.select("url_key", "page_id").distinct(), directory, folder), "located")
    return read_records(located, folder)
