"""WARC archives with a two-level capture index.

Writing: every page becomes a response or, where its payload is that of another
page, a revisit of it; records are gzip members of archive files in the shared
folder. The index holds a line for each record, sorted by reversed-host URL key, in
compressed blocks; a sparse directory has the first key of each block. Reading: a
binary search over the parts, one over a part's directory and one inside a block
find a capture, and a range read fetches its record.

A task writes files under a name of its own attempt and reports them with its rows,
so a repeated task leaves an unused file and never a wrong one.

Defined cases: a null html is an empty payload; a null URL has an empty key; a null
page_id counts as smallest and is kept as null; of rows alike in page_id and payload
all are responses if the page is; a payload of any length is one record, held whole
by its task; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import parts as parts_
from tessera.llm.parts import storage
from tessera.llm.scratch import fresh_path, materialize, release

FILE_BYTES = 64 << 20
BLOCK_LINES = 512
DATE = "2024-01-01T00:00:00Z"
ENTRY = "key string, page_id long, file string, at long, size long"
RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload binary"


def surt(url: str | None) -> str:
    """Reversed-host key, as org,example,www)/path?query in lower-case host letters."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def tasks(df: DataFrame) -> int:
    """Partitions for narrow rows that stand for much reading; a stated number is never merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if revisit else f"Content-Length: {len(payload)}\r\n".encode()) + b"\r\n"
    block = http + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(3, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[int | None, str, int | None, str, bytes]:
    """page_id, type, page_id referred to, digest and payload of a record."""
    head, _, rest = zlib.decompress(member, wbits=31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Type"], refers, fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload


def keep_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Pages as part files in ``folder``, and (part, row, page_id, digest) for each."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def facts(batch: pa.RecordBatch) -> list[pa.Array]:
        return [batch.column(0), pa.array([base32(h.as_py().encode()) for h in batch.column(2)], pa.string())]

    return parts_.store(rows, folder, 2, facts, "page_id long, digest string")


def with_roles(rows: DataFrame) -> DataFrame:
    """(part, row, digest, refers_to) of kept pages; refers_to is set for revisits. Only narrow rows meet by digest.

    Totals are written out before the join, so that it reads two exchanges and a digest
    of very many pages can be split.
    """
    first = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("response")), "digests")
    is_response = F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(first, "digest").select("part", "row", "digest", F.when(~is_response, F.col("response")).alias("refers_to"))


def write(roles: DataFrame, kept: str, parts: int, folder: str) -> DataFrame:
    """Archive the pages of folder ``kept`` with their roles in ``folder``; gives the index entries, written out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(folder)
        out, name, at = None, "", 0
        for wide, rows in parts_.of_parts(batches, kept):
            entries: list[tuple] = []
            pages = wide.batch.take(pa.array(rows["row"].to_numpy() - wide.first))
            for page, url, html, digest, refers in zip(*[c.to_pylist() for c in pages.columns], rows["digest"].to_pylist(), rows["refers_to"].to_pylist(), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{plain}/{name}", compression=None)
                data = record(page, url, b"" if refers is not None else html.encode(), digest, refers)
                out.write(data)
                entries.append((surt(url), page, name, at, len(data)))
                at += len(data)
            yield table(entries)
        if out is not None:
            out.close()

    def table(entries: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], k) for i, k in enumerate(kinds)], ["key", "page_id", "file", "at", "size"])

    return materialize(parts_.by_part(roles, parts, "row").mapInArrow(run, ENTRY), "entries")


def line(key: str, page_id: int | None, rest: dict | None = None) -> tuple[bytes, int]:
    """Sort key of an index line; null ids first, as Spark sorts them."""
    return key.encode(), -(1 << 63) if page_id is None else page_id


def build_index(entries: DataFrame, folder: str) -> DataFrame:
    """Write the sorted blocks and directories; gives a row (first, last, part) for each part."""
    dealt = entries.repartitionByRange(tasks(entries), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(folder)
        name = uuid.uuid4().hex
        out, directory, block, at, last = None, [], [], 0, None

        def flush() -> None:
            nonlocal at
            data = zlib.compress(json.dumps(block).encode())
            out.write(data)
            directory.append([block[0][0], block[0][1], at, len(data)])
            at += len(data)
            block.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{plain}/{name}.blocks", compression=None)
                block.append([row["key"], row["page_id"], row["file"], row["at"], row["size"]])
                last = block[-1][:2]
                if len(block) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with system.open_output_stream(f"{plain}/{name}.directory", compression=None) as d:
            d.write(zlib.compress(json.dumps(directory).encode()))
        yield pa.RecordBatch.from_pylist([{"first": json.dumps(directory[0][:2]), "last": json.dumps(last), "part": name}], pa.schema([("first", pa.string()), ("last", pa.string()), ("part", pa.string())]))

    return materialize(dealt.mapInArrow(run, "first string, last string, part string"), "parts")


class Index:
    """Reader of an index: its parts in order, and recently used directories and blocks."""

    def __init__(self, folder: str, parts: list[tuple[str, str, str]]):
        self.system, self.plain = storage(folder)
        found = sorted((line(*json.loads(first)), line(*json.loads(last)), name) for first, last, name in parts)
        self.firsts, self.lasts, self.names = [p[0] for p in found], [p[1] for p in found], [p[2] for p in found]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(8)(self._block)

    def _directory(self, name: str) -> tuple[list, list]:
        with self.system.open_input_file(f"{self.plain}/{name}.directory") as f:
            rows = json.loads(zlib.decompress(f.read()))
        return [line(r[0], r[1]) for r in rows], rows

    def _block(self, name: str, at: int, size: int) -> tuple[list, list]:
        with self.system.open_input_file(f"{self.plain}/{name}.blocks") as f:
            rows = json.loads(zlib.decompress(f.read_at(size, at)))
        return [line(r[0], r[1]) for r in rows], rows

    def captures(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, size) of every record with this key and page."""
        want = line(key, page_id)
        for p in range(bisect_left(self.lasts, want), bisect_right(self.firsts, want)):
            starts, rows = self.directory(self.names[p])
            for b in range(max(0, bisect_left(starts, want) - 1), bisect_right(starts, want)):
                keys, lines = self.block(self.names[p], *rows[b][2:])
                for i in range(bisect_left(keys, want), bisect_right(keys, want)):
                    yield tuple(lines[i][2:])


def lookup(wanted: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """(file, at, size) of the captures of ``wanted`` (key, page_id).

    ``parts`` has a row for each index part, as many as there were tasks.
    """
    known = [tuple(r) for r in parts.collect()]
    dealt = wanted.distinct().repartitionByRange(tasks(wanted), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, known)
        for batch in batches:
            found = [c for key, page in zip(*[c.to_pylist() for c in batch.columns], strict=True) for c in index.captures(key, page)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "at", "size"])

    return dealt.mapInArrow(run, "file string, at long, size long")


def keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["key", "page_id"])

    return pages.select(F.col("url").cast("string"), F.col("page_id").cast("long")).mapInArrow(run, "key string, page_id long")


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, by range reads in the order of the files."""
    dealt = captures.repartitionByRange(tasks(captures), "file", "at").sortWithinPartitions("file", "at")
    fields = ["page_id", "record_type", "refers_to", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = storage(folder)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, at, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file != name:
                    name, source = file, system.open_input_file(f"{plain}/{file}")
                page, kind, refers, digest, payload = parse(source.read_at(size, at))
                if kind == "response" and base32(payload) != digest:
                    raise ValueError(f"the payload of page {page} is not what was archived")
                rows.append((page, kind, refers, digest, payload))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], fields)
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], fields)

    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive and index ``pages``, look every page up and read it back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); a revisit's
    payload is that of the response it refers to.
    """
    folder, kept = fresh_path(pages.sparkSession, "warc"), fresh_path(pages.sparkSession, "pages")
    rows = keep_pages(pages, kept)
    entries = write(with_roles(rows), kept, max(1, rows.select("part").distinct().count()), folder)
    parts = build_index(entries, folder)
    records = read(lookup(keys(pages), parts, folder), folder)
    facts = materialize(records.select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    responses = materialize(facts.where("record_type = 'response'").select(F.col("page_id").alias("r"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct(), "responses")
    release(rows, entries)
    same = (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d"))
    revisits = facts.where("record_type = 'revisit'").join(responses, same, "left").select("page_id", F.col("b").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return facts.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)
