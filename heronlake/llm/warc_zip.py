"""Web archives as ZIP packages: WARC members stored whole, an index, and range reads.

Each package holds ``archive/data.warc.gz`` (a gzip member a record), ``indexes/index.cdx``
(a line a record, with its offset and length) and ``datapackage.json``, all stored, with
ZIP64 records. The reader finds members through the central directory, or the ZIP64 one,
reads the index and then single records by byte range; nothing is extracted. It also reads
other writers' packages: several archive members, JSON or classic index lines, gzipped or
plain archives and indexes, archives without an index (whole, then), records without page
ids, HTTP heads or digests.

Records with equal payloads (of ``least`` bytes or more): the one with the largest page id
is the response, the others revisit it. Null html is an empty payload. A null page id is
always a response and is never referred to; rows that repeat the largest id are all
responses. Very long payloads make a package of their own size. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm import _store

PACKAGE_BYTES = 32 << 20  # of compressed records, after which a package is closed
BROADCAST_ROWS = 500_000  # repeated payloads (28 bytes each) that may be sent to all executors
READ_TASKS = 10_000  # that packages are read in, one a task while there are fewer
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header, which has the payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _number(s: str | None) -> int | None:
    """The page of one of our record ids; null for other writers' ids."""
    digits = (s or "").strip().removeprefix("<").removesuffix(">").removeprefix(ID)
    return int(digits) if re.fullmatch(r"-?\d{1,18}", digits) else None


def parse_record(data: bytes) -> dict:
    """A WARC record of any writer. Pages are those of our ids; records without an HTTP head are payload whole; a digest that is SHA-1 is checked, any other is worked out."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}
    length = fields.get("content-length", "")
    body = rest[: int(length)] if length.isdigit() else rest
    kind = fields.get("warc-type", "")
    out = {"page_id": _number(fields.get("warc-record-id")), "record_type": kind, "url": fields.get("warc-target-uri"), "record_id": fields.get("warc-record-id"), "refers_to": None}
    payload = body
    size = None
    if body.startswith(b"HTTP/") or "application/http" in fields.get("content-type", ""):
        http, _, payload = body.partition(b"\r\n\r\n")
        size = int(m[1]) if (m := re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})", b"\r\n" + http)) else None
    said = fields.get("warc-payload-digest", "")
    said = said.split(":", 1)[1].upper() if said.lower().startswith("sha1:") else None
    if kind == "revisit":
        return out | {"payload_bytes": size if size is not None else len(payload), "payload_digest": said, "refers_to": _number(fields.get("warc-refers-to")), "payload": None}
    digest = payload_digest(payload)
    if (said and re.fullmatch("[A-Z2-7]{32}", said) and digest != said) or (length.isdigit() and len(body) < int(length)):
        raise ValueError(f"payload of record {out['record_id']} is damaged")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def package(records: list[bytes], lines: list[str]) -> bytes:
    """The ZIP file: stored members with ZIP64 fields."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((WARC, records), (INDEX, ["".join(lines).encode()]), ("datapackage.json", [json.dumps({"profile": "data-package", "resources": [{"path": WARC}, {"path": INDEX}]}).encode()])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                for x in data:
                    member.write(x)
    return out.getvalue()


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file: name to (method, stored size, offset of the local header, CRC). ``read(offset, n)`` gives bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF):
        (where,) = struct.unpack_from("<Q", tail, end - 12)
        big = read(where, 56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", big, 32)
    data, out, p = read(at, length), {}, 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, _, _, crc, stored, plain, n_name, n_extra, n_note, disk, _, _, local = struct.unpack_from("<HHHIIIHHHHHII", data, p + 10)
        name, extra = data[p + 46 : p + 46 + n_name].decode(), data[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64 values, each only for a field that is full
                v = q + 4
                for field in ("plain", "stored", "local"):
                    if {"plain": plain, "stored": stored, "local": local}[field] == 0xFFFFFFFF:
                        (x,) = struct.unpack_from("<Q", extra, v)
                        plain, stored, local = (x if field == "plain" else plain), (x if field == "stored" else stored), (x if field == "local" else local)
                        v += 8
            q += 4 + n
        out[name] = (method, stored, local, crc)
        p += 46 + n_name + n_extra + n_note
    return out


def member(read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes are, and how many."""
    method, stored, local, _ = entry
    if method != 0:
        raise ValueError("member is not stored")
    head = read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra, stored


def index_line(line: str) -> tuple[str | None, int, int] | None:
    """File name (null if it names none), offset and length of a line of an index: a key, a time and JSON with these, or the classic eleven fields; null for any other line."""
    parts = line.split(" ")
    brace = line.find("{")
    if brace >= 0:
        try:
            got = json.loads(line[brace:])
            return got.get("filename"), int(got["offset"]), int(got["length"])
        except (ValueError, KeyError, TypeError):
            return None
    if len(parts) >= 11 and parts[-3].isdigit() and parts[-2].isdigit():
        return parts[-1], int(parts[-2]), int(parts[-3])
    return None


def located(get, size: int, checked: bool = False):
    """``(member, offset, length, start)`` of each record that the package's indexes name: the bytes are at ``start + offset``.

    Any index (``indexes/``, plain or gzipped) and any stored archive member will do. Archives without an index line are read member by member
    (``length`` is null). With ``checked``, members' CRCs are compared, which reads them whole.
    """
    entries = directory(get, size)
    archives = {n: member(get, e) for n, e in entries.items() if re.search(r"\.warc(\.gz)?\Z", n)}
    if checked:
        for n, e in entries.items():
            if e[0] == 0 and e[3] != _crc(get, *member(get, e)):
                raise ValueError(f"member {n} is damaged")
    by_name = {n.rpartition("/")[2]: n for n in archives}
    named: set[str] = set()
    for n in sorted(entries):
        if re.search(r"\.(cdxj?|idx)(\.gz)?\Z", n) and not n.endswith(".idx"):
            at, length = member(get, entries[n])
            data = get(at, length)
            for line in (_gunzip(data) if n.endswith(".gz") else data).decode("utf-8", "replace").splitlines():
                got = index_line(line)
                if got is None:
                    continue
                name = by_name.get((got[0] or "").rpartition("/")[2]) or (next(iter(archives)) if got[0] is None and len(archives) == 1 else None)
                if name:
                    named.add(name)
                    yield name, got[1], got[2], archives[name][0]
    for name in sorted(set(archives) - named):
        yield name, None, None, archives[name][0]


def _crc(get, at: int, n: int) -> int:
    out = 0
    for k in range(at, at + n, 1 << 20):
        out = zlib.crc32(get(k, min(1 << 20, at + n - k)), out)
    return out


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """``offset, record`` of a whole archive member, gzipped record by record or plain."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            body = z.decompress(data[at:])
            used = len(data) - at - len(z.unused_data)
            yield at, body
        else:
            end = data.find(b"\r\n\r\n", at)
            m = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})", data[at:end]) if end >= 0 else None
            if not m:
                return
            used = end + 4 + int(m[1]) + 4 - at
            yield at, data[at : at + used]
        at += used


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def write(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of all pages in ``folder``; a table of them (``package, records, bytes``), as committed tasks wrote them."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    again = rows.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again, _ = _store.kept_table(again, "payloads")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, "sha", "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, at = [], [], 0

        def close() -> pa.RecordBatch:
            system, top = _open(folder)
            system.create_dir(top, recursive=True)
            name = uuid.uuid4().hex
            data = package(held, sorted(lines))
            with system.open_output_stream(f"{top}/{name}.part") as f:
                f.write(data)
            system.move(f"{top}/{name}.part", f"{top}/{name}.wacz")
            return pa.RecordBatch.from_pydict({"package": [f"{name}.wacz"], "records": [len(held)], "bytes": [len(data)]})

        for b in batches:
            for page_id, url, payload, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = deflate.compress(record(page_id, url, payload.as_py(), refers_to)) + deflate.flush()
                lines.append(f"{(url or '-').lower().split()[0] if (url or '-').split() else '-'} {DATE} {json.dumps({'page': page_id, 'filename': WARC.rpartition('/')[2], 'offset': at, 'length': len(data)})}\n")
                held.append(data)
                at += len(data)
                if at >= package_bytes:
                    yield close()
                    held, lines, at = [], [], 0
        if held:
            yield close()

    table, _ = _store.kept_table(rows.mapInArrow(run, "package string, records long, bytes long"), "packages")
    return table


def read(packages: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the packages, each found by the index and read by its byte range."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "package", "offset"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, package string, offset long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        for b in batches:
            for name in b.column("package").to_pylist():
                with system.open_input_file(f"{top}/{name}") as f:
                    get = lambda at, n, f=f: f.read_at(n, at)
                    out, held = [], 0
                    for where, offset, length, start in located(get, f.size()):
                        if offset is None:
                            found = records(get(*member(get, directory(get, f.size())[where])))
                        else:
                            raw = get(start + offset, length)
                            found = [(offset, _gunzip(raw) if raw[:2] == b"\x1f\x8b" else raw)]
                        for at, data in found:
                            got = parse_record(data) | {"package": name, "offset": at}
                            out.append(got)
                            held += got["payload_bytes"] if payloads else 1
                            if held >= (16 << 20 if payloads else 20_000):
                                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, types, strict=False)], names=names)
                                out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, types, strict=False)], names=names)

    # A number of tasks is given, as adaptive coalescing goes by the few bytes of the names and would have one task read all.
    tasks = min(max(packages.count(), 1), READ_TASKS)
    return packages.select("package").repartition(tasks).mapInArrow(run, schema)


def write_and_read(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, from the packages."""
    folder = _store.new_path(pages.sparkSession, "web")
    return read(write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, max(page_id) AS first FROM p GROUP BY sha),
b AS (
  SELECT sha, first, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][1 + instr('0123456789abcdef', substr(sha, i, 1)) - 1]), '') AS bits
  FROM g),
d AS (
  SELECT sha, first, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS digest
  FROM b)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM p JOIN d USING (sha)
"""
