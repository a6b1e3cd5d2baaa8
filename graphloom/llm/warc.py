"""WARC records in ZIP archives: written one archive per task, read by range without extraction.

An archive holds stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip members
of their own, and ``indexes/index.cdxj``, a sorted CDXJ line for each record: search key of its URL,
timestamp, and JSON with place and digest. The reader parses the end of the file, the ZIP64 locator where
there is one, and the central directory; finds where the stored members begin; reads the indexes; and then
reads only the bytes of the records it wants, from whichever member the index names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import drop_shared, new_path, write_shared

# Fixed values of the formats.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
GZIP = b"\x1f\x8b"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records of neighbouring ranges are read together up to so many bytes.
READ_BYTES = 4 << 20
#: Most repeated payloads whose leaders are broadcast.
MAX_BROADCAST_LEADERS = 1 << 18


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header starts


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def central_directory(f) -> list[Member]:
    """Members of a ZIP archive, from its central directory; ``f`` has size() and read_at(bytes, offset)."""
    size = f.size()
    begin = max(0, size - 22 - 65535 - 20)  # end record, longest comment, ZIP64 locator
    tail = f.read_at(size - begin, begin)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
        at = tail.rfind(END, 0, at + 3)  # a signature inside the comment: its comment would not end the file
    if at < 0:
        raise ValueError("not a ZIP archive: it has no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    ends = begin + at  # where the directory ends
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        there = [p for p in (end64, ends - 76) if 0 <= p <= size - 56 and f.read_at(4, p) == END64]
        if not there:
            raise ValueError("broken ZIP64 end of central directory")
        ends = there[0]
        count, length, start = struct.unpack("<QQQ", f.read_at(56, ends)[32:56])
    shift = ends - length - start  # bytes in front that no offset counts, as of a self-extracting archive
    if count and (shift < 0 or f.read_at(4, start + shift) != ENTRY):
        shift = 0
    data, found, at = f.read_at(length, start + shift), [], 0
    for _ in range(count):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, size, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: 8-byte values for those fields that are all ones, in this order
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size = next(values) if size == 0xFFFFFFFF else size
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        found.append(Member(name, method, size, header + shift))
        at += 46 + n_name + n_extra + n_comment
    return found


def stored_start(f, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = f.read_at(30, member.header)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, row: int) -> str:
    """Rows have a number of their own, so that repeated and missing page ids give different records."""
    return f"<{PAGE_URN}{'' if page_id is None else page_id}/{row}>"


def search_key(url: str | None) -> str:
    """The URL as CDXJ lines are sorted by: host labels reversed, then the path."""
    try:
        parts = urlsplit(url or "")
        host, path = (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        host, path, parts = "", url or "", None
    query = f"?{parts.query}" if parts and parts.query else ""
    return quote(",".join(reversed(host.split("."))) + ")" + (path + query).lower(), safe=":/?#[]@!$&()*+,;=%~-._")


def record(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, int] | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and leaves the payload out.

    ``refers_to`` is the page id and row of the response that a revisit repeats.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(page_id, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_urn(*refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
    return {"headers": headers, "payload": payload, "payload_bytes": length}


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(PAGE_URN).partition("/")[0]
    return int(number) if number else None


def write_archive(path: str, rows: Iterator[tuple], date: str) -> int:
    """Writes (page_id, row, url, payload, digest, refers_to) rows; the archive appears under its name when complete."""
    system, name = _filesystem(path)
    parent, own = name.rsplit("/", 1)
    system.create_dir(parent, recursive=True)
    draft = f"{parent}/_{own}.{uuid.uuid4().hex}"
    index, at, stamp = [], 0, "".join(c for c in date if c.isdigit())
    with system.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for page_id, row, url, payload, digest, refers_to in rows:
                packed = gzip.compress(record(page_id, row, url, payload, digest, refers_to, date), 1, mtime=0)
                member.write(packed)
                place = {"url": url, "mime": "text/html" if refers_to is None else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "length": str(len(packed)), "offset": str(at), "filename": DATA.rpartition("/")[2], "page": page_id}
                index.append(f"{search_key(url)} {stamp} {json.dumps(place)}\n".encode())
                at += len(packed)
        with archive.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            for line in sorted(index):
                member.write(line)
    system.move(draft, name)
    return len(index)


def _index_lines(f, member: Member) -> Iterator[dict]:
    """The JSON parts of an index's lines, compressed or not."""
    data = f.read_at(member.size, stored_start(f, member))
    if data[:2] == GZIP:
        data = gzip.decompress(data)
    for line in data.splitlines():
        if line.strip() and not line.startswith(b"!"):
            parts = line.split(b" ", 2)
            if len(parts) < 3 or not parts[2].lstrip().startswith(b"{"):
                raise ValueError(f"{member.name} has a line that is not CDXJ: {line[:80]!r}")
            yield json.loads(parts[2])


def _member_of(filename: str, archives: dict[str, Member]) -> Member:
    """The WARC member that an index entry names: by its path, below archive/ or in full, or by a file name that only one has."""
    for name in (f"archive/{filename}", filename):
        if name in archives:
            return archives[name]
    alike = [m for n, m in archives.items() if n.rpartition("/")[2] == filename.rpartition("/")[2]]
    if len(alike) != 1:
        raise ValueError(f"the index names {filename}, which {'no member is' if not alike else 'several members are'}")
    return alike[0]


def read_archive(path: str, wanted: set[int] | None = None) -> Iterator[dict]:
    """Records of an archive in the order they lie in, or those of the wanted pages only.

    Reads the directory, all stored ``indexes/*.cdxj`` and ``*.cdx``, gzipped or not, and the ranges they
    name in ``archive/*``. Entries may come from other writers (numbers as text or not, several WARC
    members in folders, no page); an entry that several indexes hold is read once. What cannot be read is
    an error: WARC members without any index, lines that are not CDXJ, entries of no or an unclear member.
    """
    system, name = _filesystem(path)
    with system.open_input_file(name) as f:
        members = central_directory(f)
        archives = {m.name: m for m in members if m.name.startswith("archive/") and not m.name.endswith("/")}
        indexes = [m for m in members if m.name.startswith("indexes/") and m.name.removesuffix(".gz").endswith((".cdxj", ".cdx"))]
        if archives and not indexes:
            raise ValueError(f"{path} has WARC members but no index of them")
        starts: dict[str, int] = {}
        found: set[tuple[int, int]] = set()
        for index in indexes:
            for e in _index_lines(f, index):
                if wanted is None or e.get("page") in wanted:
                    member = _member_of(e["filename"], archives)
                    if member.name not in starts:
                        starts[member.name] = stored_start(f, member)
                    begin = starts[member.name] + int(e["offset"])
                    found.add((begin, begin + int(e["length"])))
        entries = list(found)
        entries.sort()
        i = 0
        while i < len(entries):
            j, base = i + 1, entries[i][0]
            while j < len(entries) and entries[j][0] == entries[j - 1][1] and entries[j][1] - base <= READ_BYTES:
                j += 1
            data = memoryview(f.read_at(entries[j - 1][1] - base, base))
            for a, b in entries[i:j]:
                packed = data[a - base : b - base]
                yield parse(gzip.decompress(packed) if packed[:2] == GZIP else bytes(packed))
            i = j


def with_revisits(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``rows`` (row, page_id, sha1, bytes ...) with leader (page_id, row) for those that revisit it.

    Of equal payloads of at least ``least_bytes`` the largest page_id leads, of rows that share it the
    first; all others revisit it. Leaders are found from the small columns. Where the repeated payloads
    are few, they are broadcast; else each row's leader is looked up by digest on small columns alone and
    joined to the payloads by row, so payloads never meet at a digest.
    """
    small = rows.select("row", "page_id", "sha1").where(F.col("bytes") >= least_bytes)
    first = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", (-F.col("row")).alias("last")))).alias("first")
    repeated = small.groupBy("sha1").agg(first, F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    repeated, _ = write_shared(repeated.select("sha1", F.struct(F.col("first.page_id").alias("page_id"), (-F.col("first.last")).alias("row")).alias("leader")), "leaders")
    own = F.col("leader.row") == F.col("row")
    leader = F.when((F.col("bytes") >= least_bytes) & ~own, F.col("leader")).alias("leader")
    if repeated.count() <= MAX_BROADCAST_LEADERS:
        return rows.join(F.broadcast(repeated), "sha1", "left").select(*rows.columns, leader)
    found = small.join(repeated, "sha1").where(~own).select("row", "leader")
    return rows.join(found, "row", "left").select(*rows.columns, "leader")


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the stored table of archives.

    Null html is an empty payload, a null url leaves its header out, a null page_id has an empty page in
    its record id and never leads. Repeated rows are repeated records, of which one is the response. Other
    columns are ignored; an empty table gives no archive. A very long page is held whole by one task, in
    some five copies.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows, rows_path = write_shared(rows, "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records(first: pa.RecordBatch):
            for batch in chain([first], batches):
                for page_id, row, url, html, sha1, leader in zip(*(batch.column(i) for i in range(6))):
                    leader = leader.as_py()
                    yield page_id.as_py(), row.as_py(), url.as_py(), (html.as_py() or "").encode(), base64.b32encode(bytes.fromhex(sha1.as_py())).decode(), leader and (leader["page_id"], leader["row"])

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{out}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.wacz"
        n = write_archive(path, records(first), date)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    archives = with_revisits(rows, least_bytes).select("page_id", "row", "url", "html", "sha1", "leader").mapInArrow(run, "path string, records long")
    archives.write.parquet(f"{out}/_archives")
    drop_shared(pages.sparkSession, rows_path)
    return pages.sparkSession.read.schema(archives.schema).parquet(f"{out}/_archives")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for r in read_archive(path):
                h = r["headers"]
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (len(r["payload"]) != r["payload_bytes"] or payload_digest(r["payload"]) != digest):
                    raise ValueError(f"{path}: a payload does not match its digest")
                rows.append((_page(h["warc-record-id"]), r["payload_bytes"], digest, h["warc-type"], _page(h.get("warc-refers-to"))))
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records; payloads are checked against digests.

    ``archives`` (path, records) is the table that ``write_archives`` gives; other columns are ignored. An
    archive is read by one task, a range of it at a time, and a very long record whole. Records without a
    page have a null page_id, empty payloads no bytes; repeated records are rows each. No archive, or none
    with records, gives an empty result. What cannot be read is an error.
    """
    paths = archives.where("records > 0").select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, new_path(spark, "warc")))


QUERIES = {"op9_warc_archives": op9_warc_archives}
