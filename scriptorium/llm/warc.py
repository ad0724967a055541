"""WARC archives: one gzip member per record, written from rows and read back sequentially.

``write_archives`` turns rows into archives of about ``ARCHIVE_BYTES`` (one binary row each; ``save`` puts them into files):
a ``warcinfo`` record, then per row a ``response`` record, or a ``revisit`` record without payload if an equal payload is
kept elsewhere.  Of rows with equal payloads of at least ``min_bytes`` those with the largest id are responses.  Which that
is comes from a map-side combined maximum per payload digest, so a payload that a third of all rows share costs one row per
task; its rows meet the maximum in a join that the adaptive planner splits.

``read_archives`` and ``read_files`` walk an archive once, from a column or straight from files: they inflate member after
member in pieces of ``PIECE`` bytes, frame each record by its Content-Length, and check block and payload digests.  Of an
archive only the member at hand is held, so files of any size can be read.  A damaged or cut-off record yields a row with
``error`` set, and reading goes on at the next member if one can be found.

A null payload counts as empty, and a null address is left out.  Rows with equal ids and payloads are responses together.
A null id is never the largest; payloads with null ids only are all responses.  An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.textblock import each, packed

ARCHIVE_BYTES = 16 << 20
PIECE = 64 << 10
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
_ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary())])
_RECORD = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()), ("error", pa.string()),
])
RECORD_SCHEMA = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, digest_ok boolean, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


def response(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """The gzip member of a row: a response, or a revisit of the record ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = uri and "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    headers = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _member("response", headers, http + payload)
    return _member("revisit", [*headers, ("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")], http)


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made, held = TaskContext.get().partitionId(), 0, bytearray()

    def close() -> tuple[str, bytes]:
        return f"part-{part:06d}-{made:05d}.warc.gz", bytes(held)

    def rows():
        nonlocal made
        for batch in batches:
            for page, url, html, best in zip(*(each(batch.column(c)) for c in ("id", "url", "payload", "best")), strict=True):
                if not held:
                    held.extend(_member("warcinfo", [("WARC-Record-ID", f"<urn:archive:{part}:{made}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n"))
                first = page == best
                held.extend(response(f"urn:page:{page}", url, (html or "").encode(), None if first else f"urn:page:{best}"))
                if len(held) >= ARCHIVE_BYTES:
                    yield close()
                    made += 1
                    held.clear()
        if held:
            yield close()

    yield from packed(rows(), _ARCHIVE, lambda r: len(r[1]))


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(archive, content) rows that hold a record for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("payload", F.lit(""))))
    small = F.octet_length(F.coalesce("payload", F.lit(""))) < min_bytes
    best = rows.groupBy("digest").agg(F.max("id").alias("best"))
    joined = rows.join(best, "digest").select("id", "url", "payload", F.when(small, F.col("id")).otherwise(F.col("best")).alias("best"))
    return joined.mapInArrow(_archives, "archive string, content binary")


def _inflated(source: BinaryIO) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, bytes, error) of each gzip member, fed to zlib piece by piece."""
    held, at, ended = b"", 0, False  # what is read and not used, where that begins, whether there is no more

    def more() -> bool:
        nonlocal held, ended
        piece = b"" if ended else source.read(PIECE)
        ended = not piece
        held += piece
        return bool(piece)

    def skip(least: int) -> None:
        """To the next thing that looks like a member, so many bytes on at least."""
        nonlocal held, at
        while (found := held.find(b"\x1f\x8b\x08", least)) < 0:
            gone = max(0, len(held) - 2)
            held, at, least = held[gone:], at + gone, max(0, least - gone)
            if not more():
                at, held = at + len(held), b""
                return
        held, at = held[found:], at + found

    while held or more():
        while len(held) < 3 and more():
            pass
        if held[:2] != b"\x1f\x8b":
            yield at, None, "not a gzip member"
            skip(1)
            continue
        unpack, out, raw, start = zlib.decompressobj(31), [], [], at
        try:
            while not unpack.eof and (held or more()):
                raw.append(held)
                piece, held = held, b""
                out.append(unpack.decompress(piece))
            held = unpack.unused_data
            at = start + sum(map(len, raw)) - len(held)
            yield start, b"".join(out), None if unpack.eof else "the member is cut off"
        except zlib.error as e:
            yield start, None, f"zlib: {e}"
            held = b"".join(raw) + held
            skip(3)


def records(source: bytes | BinaryIO) -> Iterator[dict]:
    """Every record of an archive, in order."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    for offset, data, error in _inflated(source):
        row = dict.fromkeys(_RECORD.names) | {"offset": offset, "error": error}
        if data is None or error:
            yield row
            continue
        head, gap, rest = data.partition(b"\r\n\r\n")
        lines = head.decode(errors="replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        if not gap or not lines[0].startswith("WARC/") or not size.isdigit() or len(rest) < int(size) or rest[int(size) :] != b"\r\n\r\n":
            yield row | {"error": "bad framing"}
            continue
        block = rest[: int(size)]
        bare = lambda k: fields[k].strip("<>") if k in fields else None
        row |= {"record_type": fields.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": bare("warc-refers-to")}
        sound = "warc-block-digest" not in fields or fields["warc-block-digest"] == f"sha1:{base32_sha1(block)}"
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        payload, length = block, len(block)
        if fields.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), len(payload))
        if row["record_type"] == "revisit":
            yield row | {"payload_digest": stated, "payload_bytes": length, "digest_ok": sound}
            continue
        own = base32_sha1(payload)
        yield row | {"payload_digest": own, "payload_bytes": len(payload), "payload": payload, "digest_ok": sound and stated in (None, own) and length == len(payload)}


def read_archives(archives: DataFrame, *, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """A row per record; also reads spark.read.format("binaryFile") with its path and content columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple({**r, "archive": name}.values()) for b in batches for name, content in zip(each(b.column("archive")), each(b.column("content")), strict=True) for r in records(content or b""))
        yield from packed(rows, _RECORD, lambda r: len(r[8] or b""))

    return archives.select(F.col(name_col).alias("archive"), F.col(content_col).alias("content")).mapInArrow(read, RECORD_SCHEMA)


def read_files(spark: SparkSession, folder: str, glob: str = "*.warc.gz") -> DataFrame:
    """A row per record of the files of a folder, given as a URI that every executor reaches.  Spark lists the files; a task
    reads its files in pieces, never one as a whole."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")
    n = found.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for uri in each(b.column("path")):
                    store, path = _store(uri)
                    with store.open_input_stream(path, compression=None) as f:
                        yield from (tuple({**r, "archive": uri}.values()) for r in records(f))

        yield from packed(rows(), _RECORD, lambda r: len(r[8] or b""))

    return found.repartition(max(1, min(n, 20_000))).mapInArrow(read, RECORD_SCHEMA)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def save(archives: DataFrame, folder: str) -> None:
    """Put archives into files below a folder given as a URI that every executor reaches."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top)
        for b in batches:
            for name, content in zip(each(b.column("archive")), each(b.column("content")), strict=True):
                part = f"{top}/.{name}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content)
                store.move(part, f"{top}/{name}")  # a task that runs twice leaves whole files
            yield pa.RecordBatch.from_arrays([b.column("archive")], ["archive"])

    archives.select("archive", "content").mapInArrow(put, "archive string").write.format("noop").mode("overwrite").save()
