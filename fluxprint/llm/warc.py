"""WARC archives: written one gzip member per record, read back record by record.

``write`` lets each task stream its rows into one archive in a shared folder and returns the
committed archives; an attempt writes a file of its own name, and only files of finished
attempts are in the manifest, so lost executors and repeated tasks leave no half archive to
be read. ``read`` gives each archive to one task, which inflates it piece by piece, frames
the records by their Content-Length and verifies their digests. Files are reached through
``pyarrow.fs``, so the folder may be in any store that it knows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxprint.llm.common import text_bytes
from fluxprint.session import materialize, shared_dir

LEAST_REVISIT = 100
PIECE = 1 << 16
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
          "payload binary, digest_ok boolean, archive string")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each row; ``refers_to`` is set for revisits only.

    Null html is an empty payload. Among equal payloads of at least ``LEAST_REVISIT`` bytes the
    rows with the smallest page_id are responses (repeated rows of one page all are), the others
    refer to it; a null page_id neither refers nor is referred to. Digests are counted before
    the join, so a payload held by a third of the rows is one row on the other side.
    """
    rows = pages.select("page_id", "url", text_bytes(F.col("html")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(f"length(payload) >= {LEAST_REVISIT}").groupBy("digest").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    later = rows.select("page_id", "digest").join(first.select("digest", "first"), "digest").filter("page_id > first") \
        .select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def frame(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: header lines, then the HTTP response, without its body if it is a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


# All that a URL may hold unescaped; the percent sign itself is escaped, so that any text comes back.
SAFE = "!#$&'()*+,/:;=?@[]~"


def write(rows: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Write planned rows; the manifest (archive, records), itself a stored table."""
    base = folder or f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    base = base if re.match(r"\w+://", base) else f"file://{base}" if base.startswith("/") else re.sub(r"^file:/+", "file:///", base)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(base)
        out, name, n = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(5))):
                    if out is None:
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(member.compress(frame(*(v.as_py() for v in row))) + member.flush())
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"archive": [f"{base}/{name}"], "records": [n]})

    return materialize(rows.mapInArrow(put, "archive string, records bigint"), "warc-manifest")


def members(stream, piece: int = PIECE) -> Iterator[Iterator[bytes]]:
    """One iterator of inflated pieces per gzip member; each must be read to its end."""
    rest = stream.read(piece)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not inflate.eof:
                if not rest:
                    raise ValueError("archive ends within a record")
                yield inflate.decompress(rest)
                rest = inflate.unused_data if inflate.eof else stream.read(piece)
            rest = rest or stream.read(piece)

        yield pieces()


def parse(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and the block of one record, framed by Content-Length."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        got = next(pieces, None)
        if got is None:
            raise ValueError("record without a header")
        held += got
    first, *lines = held[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    need = end + 4 + int(fields["content-length"])
    for got in pieces:
        held += got
    if len(held) != need + 4 or held[need:] != b"\r\n\r\n":
        raise ValueError("record is not as long as its Content-Length says")
    return fields, bytes(held[end + 4:need])


def record(fields: dict[str, str], block: bytes, archive: str) -> dict:
    head, _, body = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    length = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
    number = lambda v: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", v or "")) else None
    fine = hashlib.sha256(block).hexdigest() == fields["warc-block-digest"].removeprefix("sha256:")
    if not revisit:
        fine = fine and len(body) == length and hashlib.sha256(body).hexdigest() == said
    url = fields.get("warc-target-uri")
    return {"page_id": number(fields["warc-record-id"]), "url": None if url is None else unquote(url), "payload_bytes": length,
            "payload_digest": said, "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
            "payload": None if revisit else body, "digest_ok": fine, "archive": archive}


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives of a manifest; a damaged archive fails the job, a wrong digest is reported."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
                        ("archive", pa.string())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                held, weight = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for pieces in members(stream):
                        held.append(record(*parse(pieces), archive))
                        weight += 200 + held[-1]["payload_bytes"] * payloads
                        if not payloads:
                            held[-1]["payload"] = None
                        if weight > 1 << 22:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n, "archive").mapInArrow(get, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written to archives and read back, without the payloads."""
    return read(write(planned(pages), folder), payloads=False)
