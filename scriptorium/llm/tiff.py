"""TIFF columns: bytes stored as images, and images read as one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are plain, PackBits, LZW
or deflate, undoes predictors 2 (differences) and 3 (floating point), and gives one row per page; a directory that can't be
read gives a row with ``error`` set and the others stay.  A chain that comes back to a directory ends there.  Counts and
sizes are held against the file's length, and strips against the size they claim, before anything of that size is made, so a
damaged file costs no more than its own length; strips that hold less than they should are an error.

The writer stores a text's UTF-8 bytes, padded with spaces to whole rows of 64 RGB pixels (192 bytes; an empty or null text
is one row), as 8-bit samples: at most ``PAGE_ROWS`` rows a page, in deflated strips of ``STRIP_ROWS`` rows with predictor
2.  Everything is a function of the text alone.  All steps are narrow; a task holds one document's image at a time.  Ids may
have any type; a null id is kept, and rows with equal ids are images of their own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.shared import with_fields
from scriptorium.llm.textblock import each, packed, typed

ROW = 192
PAGE_ROWS = 4096
STRIP_ROWS = 256
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the format: bytes and struct codes of the field types.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


@dataclass
class Page:
    """A decoded page: samples row by row, pixel by pixel, in the file's own byte order turned to little-endian."""

    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
                i += 1
            i += 1
    return bytes(out[:size])


def lzw_pack(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, with the format's early change of width."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    code_of = lambda w: w[0] if len(w) == 1 else table[w]
    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = 258 + len(table)
        width = (258 + len(table)).bit_length() if 258 + len(table) < 4095 else 12
        if 258 + len(table) >= 4094:
            put(256)
            table.clear()
            width = 9
        word = data[i : i + 1]
    if word:
        put(code_of(word))
        width = (259 + len(table)).bit_length()
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_unpack(data: bytes, size: int) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            word = bytes((code,))
        elif code - 258 < len(table):
            word = table[code - 258]
        elif last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (259 + len(table)).bit_length()))
        if len(out) >= size:
            break
    return bytes(out[:size])


def _pack(data: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw_pack, DEFLATE: lambda x: zlib.compress(x, 6), OLD_DEFLATE: zlib.compress, PACKBITS: pack_bits}[how](data)


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, size))
    if how not in (NONE, LZW, PACKBITS):
        raise ValueError(f"compression {how}")
    return {NONE: lambda: data[:size], LZW: lambda: lzw_unpack(data, size), PACKBITS: lambda: unpack_bits(data, size)}[how]()


def _directory(fields: list[tuple[int, int, list]], at: int) -> bytes:
    """An image directory at byte ``at``, the last one so far, with what doesn't fit into its entries behind it."""
    head, tail = struct.pack("<H", len(fields)), b""
    behind = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields):
        raw = b"".join(struct.pack(f"<{_TYPES[kind]}", v) for v in values)
        if len(raw) > 4:
            raw, tail = struct.pack("<I", behind + len(tail)), tail + raw + b"\0" * (len(raw) % 2)
        head += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + tail


def write(payload: bytes, *, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS) -> bytes:
    """A TIFF of whole rows of 64 RGB pixels; tile > 0 stores square tiles of that many pixels in place of strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for lo in range(0, len(payload), page_rows * ROW):
        image = np.frombuffer(payload[lo : lo + page_rows * ROW], np.uint8).reshape(-1, ROW // 3, 3)
        rows, columns = image.shape[:2]
        if tile:
            whole = np.pad(image, ((0, -rows % tile), (0, -columns % tile), (0, 0)))
            parts = [whole[y : y + tile, x : x + tile] for y in range(0, rows, tile) for x in range(0, columns, tile)]
        else:
            parts = [image[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            raw = _pack(part.tobytes(), compression)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        fields = [(256, 4, [columns]), (257, 4, [rows]), (258, 3, [8, 8, 8]), (259, 3, [compression]), (262, 3, [2]), (277, 3, [3]), (284, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [strip_rows]), (279, 4, sizes)]
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + 12 * len(fields)
        out += _directory(fields, len(out))
    return bytes(out)


def _undo(part: np.ndarray, predictor: int, order: str, bits: int) -> np.ndarray:
    """part: (rows, columns, samples) in the file's byte order, differences taken along the columns."""
    if predictor == 2:
        return np.cumsum(part.astype(part.dtype.newbyteorder("=")), axis=1, dtype=part.dtype.newbyteorder("="))
    if predictor == 3:
        rows, columns, samples = part.shape
        size = bits // 8
        flat = part.reshape(rows, -1).view(np.uint8).reshape(rows, columns * size, samples)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, columns, samples).astype(f"=u{size}")
    return part


def _page(content: bytes, order: str, tags: dict[int, list]) -> Page:
    one = lambda t, default=None: tags.get(t, [default])[0]
    width, height, samples, bits = one(256), one(257), one(277, 1), one(258, 1)
    how, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    if bits not in (1, 8, 16, 32) or len(set(tags.get(258, [1]))) > 1:
        raise ValueError(f"{bits} bits a sample")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    tiled = 324 in tags
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags.get(279, [len(content)] * (len(tags[273]) == 1)))
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if min(width, height, samples, across, down) < 1 or len(places) != planes * -(-height // down) * -(-width // across) or len(sizes) != len(places):
        raise ValueError("the strips or tiles don't make up the page")
    line, parts = (across * depth * bits + 7) // 8, []
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        y = k // -(-width // across) % -(-height // down) * down
        rows = down if tiled else min(down, height - y)
        raw = _unpack(content[place : place + size], how, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is cut off")
        parts.append((y, rows, raw))
    out = np.zeros((height, width, samples), kind.newbyteorder("="))  # no larger than what was decoded
    for k, (y, rows, raw) in enumerate(parts):
        plane, x = k // (len(parts) // planes), k % -(-width // across) * across
        raw = np.frombuffer(raw, np.uint8).reshape(rows, line)
        if bits == 1:
            part = np.unpackbits(raw, axis=1)[:, : across * depth].reshape(rows, across, depth)
        else:
            part = _undo(raw.reshape(-1).view(kind).reshape(rows, across, depth), predictor, order, bits)
        part = part[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + depth] = part
    return Page(width, height, samples, bits, how, predictor, tiled, out.astype(out.dtype.newbyteorder("<")).tobytes())


def pages(content: bytes) -> Iterator[Page | str]:
    """The pages of a file; in place of one that can't be read, what is wrong with it."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack(f"{order}H", content[2:4])[0] != 42:
        yield "not a TIFF"
        return
    at, seen, left = struct.unpack(f"{order}I", content[4:8])[0], set(), 4 * len(content)
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(f"{order}H", content, at)[0]
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", content, at + 2 + 12 * i)
                if kind in _TYPES:
                    code, size = _TYPES[kind], struct.calcsize(f"={_TYPES[kind]}") * count
                    where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", content, at + 10 + 12 * i)[0]
                    left -= 12 + size
                    if where + size > len(content) or left < 0:
                        raise struct.error("more values than the file holds")
                    tags[tag] = list(struct.unpack_from(f"{order}{len(code) * count}{code[0]}", content, where))
            following = struct.unpack_from(f"{order}I", content, at + 2 + 12 * n)[0]
        except struct.error:
            yield "the directory is cut off"
            return
        try:
            yield _page(content, order, tags)
        except (ValueError, KeyError, IndexError, TypeError, OverflowError, zlib.error) as e:
            yield f"{type(e).__name__}: {e}"
        at = following


_MEDIA = [("n_bytes", pa.int64()), ("media", pa.binary())]
_PAGE = [
    ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("last", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()),
    ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("data", pa.binary()), ("error", pa.string()),
]
PAGE_FIELDS = "n_bytes long, media_bytes long, media_sha256 string, page int, last boolean, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"
_DIGEST = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def write_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text of each row as a TIFF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = typed(batches, "id")

        def rows():
            for b in batches:
                for key, text in zip(each(b.column("id")), each(b.column("text")), strict=True):
                    raw = (text or "").encode()
                    yield key, len(raw), write(raw + b" " * (-len(raw) % ROW if raw else ROW))

        yield from packed(rows(), pa.schema([("id", kind), *_MEDIA]), lambda r: len(r[2]))

    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return table.mapInArrow(run, with_fields(table, ["id"], "n_bytes long, media binary"))


def read_pages(media: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per page of each image, in order; ``last`` marks an image's last row.  A null image has no rows."""
    n_bytes = F.col("n_bytes") if "n_bytes" in media.columns else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = typed(batches, "id")

        def rows():
            for b in batches:
                for key, n, content in zip(*(each(b.column(c)) for c in ("id", "n_bytes", "media")), strict=True):
                    if content is None:
                        continue
                    of, k, held = (key, n, len(content), hashlib.sha256(content).hexdigest()), 0, None
                    for page in pages(content):
                        if held is not None:
                            yield (*of, k, False, *held)
                            k += 1
                        held = (*(None,) * 8, page) if isinstance(page, str) else (page.width, page.height, page.samples, page.bits, page.compression, page.predictor, page.tiled, page.data, None)
                    yield (*of, k, True, *(held or (*(None,) * 8, "no pages")))

        yield from packed(rows(), pa.schema([("id", kind), *_PAGE]), lambda r: len(r[13] or b""))

    table = media.select(F.col(id_col).alias("id"), n_bytes.cast("long").alias("n_bytes"), F.col(media_col).alias("media"))
    return table.mapInArrow(run, with_fields(table, ["id"], PAGE_FIELDS))


def image_digests(page_rows: DataFrame) -> DataFrame:
    """One row per image of ``read_pages``'s rows, straight from there (an image's rows are still together and in order):
    length and digest of the samples, CRC-32 of their last 16 bytes, and a feature of pages, size, channel sums and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = typed(batches, "id")

        def rows():
            total = None
            for b in batches:
                names = ("id", "n_bytes", "media_bytes", "media_sha256", "last", "width", "height", "data")
                for key, n, size, sha, last, width, height, data in zip(*(each(b.column(c)) for c in names), strict=True):
                    if total is None:
                        total, length, tail, n_pages, tall, sums, edges = hashlib.sha256(), 0, b"", 0, 0, np.zeros(3, np.int64), 0
                    data = data or b""
                    total.update(data)
                    length += len(data)
                    tail = (tail + data[-16:])[-16:]
                    n_pages += 1
                    tall += height or 0
                    if len(data) and len(data) % 3 == 0:
                        flat = np.frombuffer(data, np.uint8)
                        sums += flat.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                        edges += int(np.count_nonzero(flat[1:] != flat[:-1]))
                    if last:
                        yield key, n, length, total.hexdigest(), zlib.crc32(tail), size, sha, f"pages={n_pages};size={width}x{tall};sums={','.join(map(str, sums.tolist()))};edges={edges}"
                        total = None

        yield from packed(rows(), pa.schema([("doc_id", kind), *_DIGEST]), lambda r: 300)

    fields = with_fields(page_rows.select(F.col("id").alias("doc_id")), ["doc_id"], "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return page_rows.mapInArrow(run, fields)
