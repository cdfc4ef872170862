"""WARC archives of web pages: a distributed writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgrid.llm.common import BROADCAST_ROWS, keep, lookup, maybe_broadcast, new_folder

ARCHIVE_BYTES = 32 << 20
CHUNK = 16 << 10
# tasks that read archives; with more archives than that a task reads several, one after another
MOST_TASKS = 20_000
# fixed values of the format
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
DATE = "2020-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of `refers_to` with the HTTP header alone."""

    def urn(number: int | None) -> str:
        return f"<urn:page:{'' if number is None else number}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": urn(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "Content-Length": str(len(block)),
    }
    if url:
        headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    if refers_to is not None:
        headers |= {"WARC-Refers-To": urn(refers_to), "WARC-Profile": REVISIT_PROFILE}
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(record) + packer.flush()


@dataclass
class Record:
    """A record that passed all checks, and where in the file it lies."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> tuple[bytes, int]:
        """The payload that the block holds, and the length that its HTTP header states."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        return body, int(stated[1]) if stated else len(body)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at `at`; ValueError if any check fails."""
    version = VERSION.match(data, at)
    head_end = data.find(b"\r\n\r\n", at)
    if not version or head_end < 0:
        raise ValueError("no version line or no end of the header")
    headers = {}
    for line in data[version.end() : head_end].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.strip().lower()] = value.strip()
    if not MANDATORY <= headers.keys():
        raise ValueError("a mandatory header is missing")
    length = headers["content-length"]
    if not length.isdecimal():
        raise ValueError("no valid content length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end where it should")
    block = data[start:end]
    for name in checked_digests(headers):
        content = block if name == "warc-block-digest" else block.partition(b"\r\n\r\n")[2]
        if headers[name][5:] != sha1_base32(content):
            raise ValueError(f"{name} does not match")
    return headers, block, end + 4


def checked_digests(headers: dict[str, str]) -> list[str]:
    """The headers of a record whose digest can be compared with its block."""
    names = ["warc-block-digest"] + ["warc-payload-digest"] * (headers.get("warc-type") == "response")
    return [n for n in names if headers.get(n, "").startswith("sha1:")]


def inflate(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int, str]:
    """What the compressed member at `at` inflates to, where its bytes end, and what is wrong with it, "" if nothing.

    Of a damaged or cut member it is all that comes before the damage. With `most` it stops after the byte of the member
    with which so many bytes are inflated.
    """
    unpacker, view, raw, size, end, step = zlib.decompressobj(31), memoryview(data), [], 0, at, CHUNK
    while end < len(data) and not unpacker.eof:  # in chunks, as what lies behind the member is copied
        before = unpacker.copy() if step > 1 else None
        try:
            out = unpacker.decompress(view[end : end + step])
            over = most is not None and size + len(out) >= most
        except zlib.error:
            if step == 1:
                return b"".join(raw), end, "damaged member"
            over = True
        if over and step > 1:  # the same chunk again, byte by byte
            unpacker, step = before, 1
            continue
        raw.append(out)
        size, end = size + len(out), end + len(view[end : end + step])
        if over:
            break
    return b"".join(raw), end - len(unpacker.unused_data), "" if unpacker.eof else "the member has no end"


def plain_records(raw: bytes) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The records (end, headers, block) of inflated bytes that pass all checks, and the gaps (start, end, reason)."""
    records, gaps, at, bad, reason = [], [], 0, None, ""
    while at < len(raw):
        try:
            headers, block, end = parse_record(raw, at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            following = VERSION.search(raw, at + 1)
            at = following.start() if following else len(raw)
            continue
        if bad is not None:
            gaps.append((bad, at, reason))
            bad = None
        records.append((end, headers, block))
        at = end
    if bad is not None:
        gaps.append((bad, len(raw), reason))
    return records, gaps


def parse_member(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], list[str], int, str]:
    """Records of the compressed member at `at`, its inner gaps, how far they reach, and the damage behind, "" if none.

    ValueError if no record passes. A damaged member that is one record and nothing else is as damaged as the member. In
    a member that does not inflate or whose checksum fails, a record needs a digest of its own to pass.
    """
    raw, end, damage = inflate(data, at)
    records, gaps = plain_records(raw)
    if damage:
        if [e for e, *_ in records] == [len(raw)] and not gaps:
            raise ValueError(damage)
        if damage == "damaged member":
            gaps += [(e, e, "no digest in a damaged member") for e, headers, _ in records if not checked_digests(headers)]
            records = [r for r in records if checked_digests(r[1])]
    if not records:
        raise ValueError(damage or (gaps[0][2] if gaps else "empty member"))
    if damage:
        last = records[-1][0]
        end = inflate(data, at, last)[1]
        gaps = [g for g in gaps if g[0] < last]
    inner = [f"in the member, up to inflated byte {z}: {why}" for _, z, why in sorted(gaps)]
    return [(headers, block) for _, headers, block in records], inner, end, damage


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All records of an archive that pass their checks, and the byte gaps (start, end, reason) between them.

    A position is read as a compressed member or as a plain record. Where a check fails, the bytes are quarantined up
    to the next position that begins a member or a version line and passes all checks itself. In the inflated bytes of a
    member, and in those before its damage, the next record is looked for in the same way. So damage costs only the
    records that it touches. Records and gaps come in file order and cover the file; those inside a member have its
    place in the file. An empty file gives nothing.
    """
    starts = re.compile(re.escape(MEMBER) + rb"|" + VERSION.pattern)
    at, bad, reason = 0, None, ""
    while at < len(data):
        inner, damage = [], ""
        try:
            if data.startswith(MEMBER, at):
                found, inner, end, damage = parse_member(data, at)
            else:
                headers, block, end = parse_record(data, at)
                found = [(headers, block)]
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            following = starts.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield bad, at, reason
            bad = None
        for headers, block in found:
            yield Record(at, end, headers, block)
        for why in inner:
            yield at, end, why
        at = end
        if damage:
            bad, reason = end, damage
            following = starts.search(data, end)
            at = following.start() if following else len(data)
    if bad is not None:
        yield bad, len(data), reason


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row to archives under `folder`; returns the written manifest (path, records).

    Of rows with equal payloads of at least `least_bytes` the one with the largest id is a response and the others
    revisit it; smaller payloads are all responses. Rows that repeat the largest id are responses too. A row without id
    revisits a row that has one. Null payloads are empty. Every task writes files under names of its own and the
    manifest lists those of the attempt that ended, so a lost executor leaves no half archive in it.
    """
    payload = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
    )
    shared = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    shared = keep(shared, "warc-shared")
    n = shared.count()
    if n <= BROADCAST_ROWS:
        rows = rows.join(maybe_broadcast(shared, n), "digest", "left")
    else:
        rows = lookup(rows, shared, "digest")
    base = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(base)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem = f"pages-{context.partitionId():06d}-{uuid.uuid4().hex}"
        stream, path, size, records, number = None, "", 0, 0, 0

        def close():
            stream.close()
            return pa.record_batch({"path": [path], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    path = f"{stem}-{number:04d}.warc.gz"
                    stream, size, records, number = fs.open_output_stream(f"{root}/{path}", compression=None), 0, 0, number + 1
                text = base64.b32encode(bytes.fromhex(digest)).decode()
                refers_to = None if first is None or first == page_id else first
                data = member(page_record(page_id, url, payload, text, refers_to))
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    manifest = rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, "path string, records long")
    return keep(manifest.select(F.concat(F.lit(base + "/"), "path").alias("path"), "records"), "warc-manifest")


def read_archives(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and quarantined gaps of the archives listed in the column `path`.

    Records: path, start, end, record_type, record_id, refers_to (both ids as numbers, null if absent), uri, payload,
    payload_bytes and payload_digest of the full payload (a revisit states them without holding it). Gaps: path, start,
    end, reason. One archive is held in memory at a time. An unreadable file is one gap from 0 to -1. Whether every record
    that was written is found again is for `verified_records` to say.
    """
    found = _found(manifest)
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select(*GAP)


def verified_records(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without their payloads, and gaps, of the archives of a manifest (path, records), read once.

    Raises if an archive gives another number of records than the manifest states: a missing or damaged archive never
    passes for a smaller one.
    """
    found = keep(_found(manifest).drop("payload"), "warc-records")
    read = found.groupBy(F.col("path").alias("read_path")).agg(
        F.count_if(F.col("reason").isNull()).alias("n"), F.min_by("reason", F.col("reason").isNull()).alias("reason")
    )
    wrong = manifest.join(read, F.col("path") == F.col("read_path"), "left").where(
        F.coalesce("n", F.lit(0)) != F.col("records")
    )
    if bad := wrong.select("path", "records", F.coalesce("n", F.lit(0)).alias("n"), "reason").limit(5).collect():
        told = "; ".join(f"{r['path']}: {r['n']} of {r['records']} records, {r['reason'] or 'no gap'}" for r in bad)
        raise ValueError(f"archives do not hold the records that were written: {told}")
    return found.where("reason is null").drop("reason"), found.where("reason is not null").select(*GAP)


def _found(manifest: DataFrame) -> DataFrame:
    """What `read_archives` finds, records and gaps in one frame."""

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    fs, name = file_system(path)
                    with fs.open_input_stream(name, compression=None) as f:
                        data = f.read()
                except OSError as e:
                    rows.append({"path": path, "start": 0, "end": -1, "reason": str(e)})
                    data = b""
                for x in salvage(data):
                    if isinstance(x, tuple):
                        rows.append({"path": path, "start": x[0], "end": x[1], "reason": x[2]})
                        continue
                    payload, stated = x.payload()
                    kind = x.headers.get("warc-type")
                    whole = kind != "revisit"
                    rows.append(
                        {
                            "path": path,
                            "start": x.start,
                            "end": x.end,
                            "record_type": kind,
                            "record_id": number(x.headers.get("warc-record-id")),
                            "refers_to": number(x.headers.get("warc-refers-to")),
                            "uri": x.headers.get("warc-target-uri"),
                            "payload": payload if whole else None,
                            "payload_bytes": len(payload) if whole else stated,
                            "payload_digest": sha1_base32(payload)
                            if whole
                            else x.headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                        }
                    )
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    # a fixed number of tasks: by the bytes of their paths all archives would end up in one
    tasks = min(max(manifest.count(), 1), MOST_TASKS)
    return manifest.select("path").repartition(tasks).mapInArrow(read, DDL)


GAP = ["path", "start", "end", "reason"]
SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("reason", pa.string()),
        ("record_type", pa.string()),
        ("record_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("uri", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)
DDL = (
    "path string, start long, end long, reason string, record_type string, record_id long, refers_to long, uri string, "
    "payload binary, payload_bytes long, payload_digest string"
)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Raises if an archive is missing or gives fewer records than were written to it.
    """
    manifest = write_archives(pages, folder or new_folder(pages.sparkSession, "warc"), **options)
    records, _ = verified_records(manifest)
    return records.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
