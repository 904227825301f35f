"""WARC records in ZIP-packaged archives: writing, and reading by range without extraction.

An archive is a ZIP file in the shared folder with two stored (uncompressed) members: ``archive/data.warc`` with the records and
``indexes/index.jsonl`` with a line for each record (its URI, place and length in the data member). The reader opens the file where it
lies and starts at its end: end record, ZIP64 locator and end record where the sizes need them, central directory, the members' local
headers; then it reads the index, and the records by their ranges, neighbours in one read of at most RANGE_BYTES. Nothing else is read,
and no archive is in memory as a whole. Archives of others may have several data members, records that are gzip members of their own,
CDXJ indexes, and records of other types.

Records with equal payloads are written once, as a response; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_beside, releasing

DATA, INDEX = "archive/data.warc", "indexes/index.jsonl"
#: An archive is closed at this many bytes of records, or with its task's rows. A record that is larger is one archive; it is a cell of
#: the table before, so its size is bounded by what a row may hold.
ARCHIVE_BYTES = 8 << 20
#: Neighbouring records are read together up to this many bytes; archives of so many bytes are read by one task.
RANGE_BYTES, TASK_BYTES = 1 << 20, 64 << 20
DATE = "2020-01-01T00:00:00Z"
URN = "urn:x-page:"
U32, U16 = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # of its bytes in the file
    size: int
    stored: bool


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record. The block is an HTTP response; a revisit's block ends with the headers, which keep the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[tuple[str, bytes]], force_zip64: bool = False) -> bytes:
    """A ZIP file of the two members from (uri, record) pairs."""
    data, index, at = [], [], 0
    for uri, raw in records:
        index.append(json.dumps({"uri": uri, "offset": at, "length": len(raw)}, ensure_ascii=False))
        data.append(raw)
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((DATA, data), (INDEX, ["\n".join(index).encode()])):
            with z.open(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=force_zip64) as member:
                for part in body:
                    member.write(part)
    return out.getvalue()


def members(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The members that a ZIP file's central directory lists. ``read(start, length)`` gives a range of the file's bytes.

    Raises ValueError if there is no end record or a directory entry is broken.
    """
    tail_at = max(0, size - (22 + U16))
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<H", tail, at + 10)[0], *struct.unpack_from("<II", tail, at + 12)
    if count == U16 or length == U32 or start == U32:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, out = read(start, length), 0, []
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # only the fields that don't fit above, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                whole = next(wide) if whole == U32 else whole
                packed = next(wide) if packed == U32 else packed
                header = next(wide) if header == U32 else header
            k += 4 + n
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        skip = 30 + sum(struct.unpack_from("<HH", local, 26))
        out.append(Member(name, header + skip, packed, method == 0))
        at += 46 + n_name + n_extra + n_note
    return out


def parse(raw: bytes) -> dict:
    """type, record_id, page_id, uri, digest, refers_to, payload_bytes and payload of one record, which may be a gzip member.

    payload: what follows the HTTP headers, or the whole block where there are none; None in a revisit, whose payload_bytes are
    what its HTTP headers say, else None. page_id and refers_to are numbers in ids of this module's form, else None.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}
    if not lines[0].startswith("WARC/") or not gap or not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("not a WARC record")
    block, kind = rest[:int(fields["content-length"])], fields["warc-type"].lower()
    revisit, length, payload = kind == "revisit", None, block
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    number = lambda x: int(m[1]) if (m := re.fullmatch(rf"<{URN}(-?\d+)>", x or "")) else None
    return {"type": kind, "record_id": fields.get("warc-record-id"), "page_id": number(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number(fields.get("warc-refers-to")) if revisit else None,
            "payload_bytes": length if revisit else len(payload), "payload": None if revisit else payload}


def index_entries(body: bytes) -> Iterator[dict]:
    """The entries of an index: lines of JSON, or of a sort key, a time and JSON (CDXJ); may be compressed as a whole."""
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    for line in body.splitlines():
        at = line.find(b"{")
        if at >= 0 and not line.startswith(b"!"):
            entry = json.loads(line[at:])
            if "offset" in entry and "length" in entry:
                yield {"offset": int(entry["offset"]), "length": int(entry["length"]), "filename": entry.get("filename")}


def records(read: Callable[[int, int], bytes], size: int, range_bytes: int = RANGE_BYTES) -> Iterator[dict]:
    """The records of an archive that its indexes list, read by their ranges of the data members."""
    found = members(read, size)
    data = {m.name.removeprefix("archive/"): m for m in found if m.name.startswith("archive/") and not m.name.endswith("/")}
    indexes = [m for m in found if m.name.startswith("indexes/") and not m.name.endswith("/")]
    if not data or not indexes:
        raise ValueError("an archive has data members and an index")
    if not all(m.stored for m in (*data.values(), *indexes)):
        raise ValueError("members must be stored")
    only = next(iter(data.values())) if len(data) == 1 else None

    def flush(entries: list[tuple[int, int]]) -> Iterator[dict]:
        if entries:
            start = entries[0][0]
            piece = read(start, entries[-1][0] + entries[-1][1] - start)
            for at, n in entries:
                yield parse(piece[at - start:at - start + n])

    held: list[tuple[int, int]] = []
    for index in indexes:
        for entry in index_entries(read(index.start, index.size)):
            member = data.get((entry["filename"] or "").removeprefix("archive/")) or only
            if member is None:
                raise ValueError("an index entry names no data member")
            if entry["offset"] < 0 or entry["offset"] + entry["length"] > member.size:
                raise ValueError("a record lies outside its member")
            at = member.start + entry["offset"]
            if held and (at != held[-1][0] + held[-1][1] or at + entry["length"] - held[0][0] > range_bytes):
                yield from flush(held)
                held = []
            held.append((at, entry["length"]))
    yield from flush(held)


def _file(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a URI or a path names, as tasks see it, and the path in it."""
    path = re.sub("^file:/(?!/)", "file:///", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ZIP archives with a record for every row to the workspace's folder, and returns (path, size) of them.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others revisit it;
    rows that repeat that id are responses too, and so are rows without an id where no equal one has one. A null html is an empty
    payload, a null url an empty URI; line breaks in a URI are escaped. Digests are grouped with partial aggregation; a revisit is
    found by its row's key, few keys are broadcast, so that payloads aren't shuffled and copies aren't gathered. An archive's name is
    the hash of its content, so a task that runs twice leaves the same files.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload"))).withColumn("key", F.xxhash64("id", "sha"))
    keys = work.keep(rows.where("sha IS NOT NULL").select("id", "sha", "key"), "keys")
    first = work.keep(keys.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").select("sha", "first"), "firsts")
    again = work.keep(join_beside(keys, first, "sha").where("NOT id <=> first").select("key", "first").distinct(), "revisits")
    rows = join_beside(rows.select("key", "id", "url", "payload"), again, "key", "left").select("id", "url", "payload", "first")
    folder = work.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            content = pack(held)
            path = f"{folder}/{hashlib.sha256(content).hexdigest()}.wacz"
            store, inside = _file(path)
            store.create_dir(inside.rpartition("/")[0])
            with store.open_output_stream(inside) as out:
                out.write(content)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64())], ["path", "size"])

        for batch in batches:
            for key, url, payload, first in zip(*batch.columns, strict=True):
                key, first = key.as_py(), first.as_py()
                uri = url.as_py().replace("\r", "%0D").replace("\n", "%0A")
                held.append((uri, record(key, uri, payload.as_py(), first, first is not None)))
                size += len(held[-1][1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    # equal archives are one file: the list keeps both rows, so that repeated rows stay repeated
    return work.keep(rows.mapInArrow(releasing(run), "path string, size long"), "archive_list")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that (path, size) rows name: page_id, record_id, uri, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null in revisits).

    Paths are those of a store that tasks can open. Records of any type come; the digest of a payload that is there is checked.
    A broken archive raises.
    """
    schema = "page_id long, record_id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    fields = ("page_id", "record_id", "uri", "payload_bytes", "digest", "type", "refers_to", "payload")[:7 + payloads]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[:7 + payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inside = _file(path)
                out, held = [], 0

                def close() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], t) for f, t in zip(fields, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

                with store.open_input_file(inside) as file:
                    def read(at: int, n: int) -> bytes:
                        file.seek(at)
                        return file.read(n)

                    for r in records(read, size):
                        if r["payload"] is not None and r["digest"] and digest(r["payload"]) != r["digest"]:
                            raise ValueError(f"payload of record {r['record_id']} does not match its digest")
                        held += len(r["payload"] or b"") if payloads else 0
                        out.append({f: r[f] for f in fields})
                        if len(out) >= 10_000 or held > RANGE_BYTES:
                            yield close()
                            out, held = [], 0
                if out:
                    yield close()

    n, total = archives.selectExpr("count(*)", "coalesce(sum(size), 0)").first()
    tasks = max(1, min(n, max(archives.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)))
    return archives.select("path", "size").repartition(tasks).mapInArrow(releasing(run), schema)
