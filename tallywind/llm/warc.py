"""WARC archives from page tables, and the normaliser of monolithic gzip (operator 2).

Writers emit whole-file gzip streams, as many crawlers do. The normaliser inflates such a file once, in steps,
rewrites every record as a gzip member of its own and writes a sidecar offset index, so that any record can be
read by one seek. Records with equal payloads of at least `shared_from` bytes are stored once: the one with the
largest page_id is a response, the others are revisits of it.

Archives are rolled at a bounded size; they live in the shared folder, and tables of their names tell which
attempts of lost tasks don't count. Copies meet in an aggregate that combines before its shuffle, and the join
back on the payload's digest is one that Spark can split.

Defined results: a null html is an empty payload; a null page_id is never the largest: such a row revisits the
group's largest, or is a response where all are null; rows that repeat the largest page_id are all responses;
repeated rows stay; a null url is empty; an empty table gives no rows; other columns aren't read. A page of any length
is one record, of which writer and readers hold one at a time beside an archive of ROLL bytes; archives that end
within a record or a gzip member raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.llm.common import new_folder, read_file, read_range, save, shared_fs, spread, write_file

ROLL = 32 << 20
STEP = 1 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%20" for c in url or ""),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, the record's bytes) from the inflated stream; holds one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (at := held.find(b"\r\n\r\n")) >= 0:
            head = parse_head(bytes(held[:at]))
            end = at + 4 + int(head["content-length"]) + 4
            if len(held) < end:
                break
            yield head, bytes(held[:end])
            del held[:end]
    if held.strip():
        raise ValueError("the archive ends within a record")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(uri: str) -> Iterator[bytes]:
    """The contents of a gzip file of one or many members, in steps of bounded size; raises ValueError where it is cut short."""
    fs, path = shared_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        z, within = zlib.decompressobj(31), False
        while data := f.read(STEP):
            while data:
                within = True
                yield z.decompress(data, STEP)
                while z.unconsumed_tail:
                    yield z.decompress(z.unconsumed_tail, STEP)
                data = z.unused_data
                if z.eof:
                    z, within = zlib.decompressobj(31), False
    if within:
        raise ValueError(f"{uri} ends within a gzip member")


def normalise(uri: str, to: str, level: int = 6) -> list[dict]:
    """Rewrite a monolithic archive with a member per record; returns, and writes beside it, its offset index."""
    out, index, at = [], [], 0
    for head, data in split_records(inflate(uri)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        out.append(member)
        index.append({"archive": to, "offset": at, "length": len(member), "record_id": head["warc-record-id"], "record_type": head["warc-type"]})
        at += len(member)
    write_file(to, b"".join(out))
    write_file(f"{to}.idx", "".join(f"{x['offset']} {x['length']} {x['record_id']} {x['record_type']}\n" for x in index).encode())
    return index


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, raw, z = [], 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            name = f"{folder}/{task:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
            write_file(name, b"".join([*parts, z.flush()]))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

        for b in batches:
            for page_id, url, html, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), kind, refers)
                parts.append(z.compress(data))
                raw += len(data)
                if raw >= ROLL:
                    yield flush()
                    parts, raw, z = [], 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        if raw:
            yield flush()

    return run


def _normalise(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows = normalise(name, f"{folder}/{uuid.uuid4().hex[:6]}-{name.rsplit('/', 1)[1]}", level)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64() if n in ("offset", "length") else pa.string()) for n in names], names)

    return run


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one member; raises ValueError where the payload's digest differs."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = parse_head(head)
    payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")[2]
    if h["warc-type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != h["warc-payload-digest"]:
        raise ValueError(f"{h['warc-record-id']}: the payload's digest differs")
    return h, payload


def read_sidecar(archive: str) -> dict[str, tuple[int, int, str]]:
    """record_id to (offset, length, record_type), from the index beside a normalised archive."""
    rows = (x.split(" ") for x in read_file(f"{archive}.idx").decode().splitlines())
    return {record: (int(offset), int(length), kind) for offset, length, record, kind in rows}


def fetch(archive: str, record: str) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record, by its sidecar offset: reads that member's bytes alone."""
    offset, length, _ = read_sidecar(archive)[record]
    return read_record(read_range(archive, offset, length))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [f.split()[0] for f in RESULT.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    last, data = None, b""
    for b in batches:
        rows = []
        for archive, offset, length in zip(*(b.column(n).to_pylist() for n in ("archive", "offset", "length")), strict=True):
            if archive != last:
                last, data = archive, read_file(archive)
            h, payload = read_record(data[offset : offset + length])
            size = len(payload) if h["warc-type"] == "response" else int(h["x-payload-length"])
            digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
            number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
            rows.append((number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page")))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def write_archives(pages: DataFrame, folder: str | None = None, shared_from: int = 1000, level: int = 1) -> DataFrame:
    """Write pages(page_id, url, html) as monolithic archives; the table of their names."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    shared = rows.where(F.octet_length("html") >= shared_from).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    told = rows.join(shared.select("digest", "first"), "digest", "left")
    kind = F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    told = told.select("page_id", "url", "html", kind.alias("kind"), F.when(kind == "revisit", F.col("first")).alias("refers"))
    return save(told.mapInArrow(_write(folder or new_folder(pages.sparkSession, "warc"), level), "archive string"), "warc-names")


def normalise_archives(names: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Rewrite the named archives (archive string) with a member per record; the index of all of them."""
    folder = folder or new_folder(names.sparkSession, "warc-members")
    return save(names.repartition(spread(names), "archive").mapInArrow(_normalise(folder, level), INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that the index names."""
    return index.select("archive", "offset", "length").repartition(spread(index.select("archive").distinct()), "archive").sortWithinPartitions("archive", "offset").mapInArrow(_read, RESULT)
