"""WARC archives: written as one gzip stream each, normalised to a gzip member for each record with a sidecar index, read back.

write_archives() gathers records into archives, each of them one gzip stream as careless crawlers leave them. normalise()
inflates each such stream once, in pieces, cuts the records out by their headers, writes every record again as a member of
its own, and beside it an index of (offset, length, type, record id). read_records() seeks by that index alone, so any record
can be read without the others. Records are told apart by their Content-Length, so payloads may hold anything.

Pages with equal payloads: the one with the largest page_id is the response, the others are revisits that refer to it.

Scale: who refers to whom is found on (digest, id) alone; payloads move only to be joined with that, and by id, so a payload
that a third of all pages share is no hot key. Archives are rolled over at `archive_bytes`; a task holds one record and one
piece of a stream. Files go to the shared folder; names are new for each attempt and only those that a finished task reports
are read, so a lost executor's files are never taken up.

Cases: null html is an empty payload. A page without an id is written too, as a response, and has no id when read; it neither
refers to others nor is referred to. Pages of one id and payload are all responses. Null urls have no target header; line
breaks in urls are escaped. Other columns, whatever their names, are left alone. Ids are bigints, or text that holds one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, new_path, partitions, small_batches, unused

ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
_GZIP = 31


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None = None) -> bytes:
    """One record. A revisit has the response's HTTP head without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-cased name, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of bytes, cut by their Content-Length."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            length = next(int(x.split(b":", 1)[1]) for x in bytes(held[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            stop = end + 4 + length + 4
            if len(held) < stop:
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("an archive ends within a record")


def inflated(stream, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever number of members it has, in pieces."""
    z = zlib.decompressobj(_GZIP)
    while raw := stream.read(piece):
        while raw:
            out = z.decompress(raw, piece)
            while out:
                yield out
                out = z.decompress(z.unconsumed_tail, piece) if z.unconsumed_tail else b""
            raw = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(_GZIP)
    if out := z.flush():
        yield out


def with_referrals(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 0, refers_to: str = "refers_to") -> DataFrame:
    """pages with `refers_to`: the response's id for pages that are revisits. Payloads under `least` bytes are never revisits.

    A column of pages named `refers_to` gives way to it.
    """
    pages = pages.drop(refers_to)
    raw = F.coalesce(F.col(html), F.lit(""))
    page, sha, key = unused(pages, "_page", "_sha", "_key")
    own = pages.where(F.octet_length(raw) >= least).select(F.col(page_id).alias(page), F.sha2(raw.cast("binary"), 256).alias(sha))
    tops = own.groupBy(sha).agg(F.max(page).alias(refers_to))
    revisits = own.where(F.col(page).isNotNull()).join(tops, sha).where(F.col(page) != F.col(refers_to)).distinct()
    revisits = materialised(revisits, "revisits")
    keyed = pages.withColumn(key, F.sha2(raw.cast("binary"), 256))
    found = keyed.join(revisits, (keyed[page_id] == revisits[page]) & (keyed[key] == revisits[sha]), "left")
    return found.select(*(keyed[c] for c in pages.columns), revisits[refers_to])


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", refers_to: str = "refers_to", archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Writes a record for each row (with `refers_to`) and gives (path, records) of the archives, each one gzip stream."""

    def run(batches):
        stream = z = None
        size = n = 0
        path = ""
        fs_, root = _open(folder)
        fs_.create_dir(root, recursive=True)

        def close():
            stream.write(z.flush())
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, target, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                payload = (payload or "").encode()
                if stream is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, n = f"{folder}/{name}", 0, 0
                    stream, z = fs_.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                raw = record("response" if refers is None else "revisit", page, target, payload, digest(payload), len(payload), refers)
                stream.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    rows = pages.select(F.col(page_id).cast("bigint"), F.col(url).cast("string"), F.col(html), F.col(refers_to).cast("bigint"))
    small_batches(pages.sparkSession)
    return rows.mapInArrow(run, "path string, records bigint")


def normalise_file(path: str, folder: str, level: int = 6) -> tuple[str, str, int]:
    """(archive, index, records): the records of one archive, inflated once, each as a member of its own; and where they are."""
    from_fs, source = _open(path)
    to_fs, root = _open(folder)
    to_fs.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.gz"
    at = n = 0
    with from_fs.open_input_stream(source, compression=None) as stream, to_fs.open_output_stream(f"{root}/{name}", compression=None) as out, to_fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
        for raw in records(inflated(stream)):
            fields, _ = parse(raw[: raw.index(b"\r\n\r\n") + 4])
            z = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
            member = z.compress(raw) + z.flush()
            out.write(member)
            index.write(f"{at} {len(member)} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
            at, n = at + len(member), n + 1
    return f"{folder}/{name}", f"{folder}/{name}.idx", n


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, records) of the normalised form of each archive in (path)."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                archive, index, n = normalise_file(path, folder)
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "index", "records"])

    spark = archives.sparkSession
    return archives.select("path").repartition(4 * partitions(spark), F.xxhash64("path")).mapInArrow(run, "path string, index string, records bigint")


def read_members(path: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a normalised archive, each by its offset alone."""
    files, at = _open(path)
    with files.open_input_stream(_open(index)[1], compression=None) as f:
        lines = f.read().decode().splitlines()
    with files.open_input_file(at) as f:
        for line in lines:
            offset, length, _, _ = line.split(" ", 3)
            f.seek(int(offset))
            yield parse(zlib.decompress(f.read(int(length)), _GZIP))


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records of normalised archives (path, index).

    A response's size and digest are those of the payload read; a revisit's are the ones it declares.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for fields, block in read_members(path, index):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "response":
                        size, sha1 = len(payload), digest(payload)
                        if f"sha1:{sha1}" != fields["warc-payload-digest"]:
                            raise ValueError(f"{path}: a payload isn't what its record says")
                    else:
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((_page(fields["warc-record-id"]), size, sha1, fields["warc-type"], _page(fields.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    spark = archives.sparkSession
    return archives.select("path", "index").repartition(4 * partitions(spark), F.xxhash64("path")).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages written, normalised and read back: read_records() of them."""
    folder = new_path(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", "html")
    written = materialised(write_archives(with_referrals(pages, least=least), f"{folder}/raw", archive_bytes=archive_bytes), "archives")
    return read_records(materialised(normalise(written, f"{folder}/normal"), "normalised"))
