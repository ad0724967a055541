"""Glyph pack files, read and written through Spark's Python data source interface.

A file holds, little-endian: the four letters of ``MAGIC``, version 1 (u32), the length of the pack's name (u16) and the name,
grid width and height (u16 each), threshold and the three weights (f32), the number of prototypes (u32), and per prototype
its code point (u32), holes, ends and forks (u8 each), one byte of padding, the aspect (f32), the bitmap's length (u32) and
the bitmap (0 or 255 for each cell of the grid).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from scriptorium.sources.files import store

# Fixed values of the format.
MAGIC, VERSION, SUFFIX = b"CLPK", 1, ".clpk"
#: The folder of what isn't committed yet.
PARTS = "_parts"
SCHEMA = "pack_id string, grid_w int, grid_h int, threshold float, w_ncc float, w_struct float, w_aspect float, proto_no int, codepoint long, holes int, endpoints int, junctions int, aspect float, bitmap binary"


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA; ValueError for what is too small, not such a file, of another version or cut off."""
    if len(data) < 8:
        raise ValueError("too small")
    if data[:4] != MAGIC:
        raise ValueError("not a glyph pack")
    if struct.unpack_from("<I", data, 4)[0] != VERSION:
        raise ValueError("unknown version")
    try:
        size = struct.unpack_from("<H", data, 8)[0]
        at = 10 + size
        if at > len(data):
            raise struct.error
        head = (data[10:at].decode(), *struct.unpack_from("<HHffff", data, at))
        n = struct.unpack_from("<I", data, at + 20)[0]
        at += 24
        for k in range(n):
            cp, holes, ends, forks, aspect, length = struct.unpack_from("<IBBBxfI", data, at)
            at += 16
            if at + length > len(data):
                raise struct.error
            yield (*head, k, cp, holes, ends, forks, aspect, data[at : at + length])
            at += length
    except struct.error:
        raise ValueError("cut off") from None


def build(rows: list) -> bytes:
    """The file of one pack's rows, in order of proto_no."""
    rows = sorted(rows, key=lambda r: r["proto_no"])
    r = rows[0]
    name = r["pack_id"].encode()
    out = [MAGIC, struct.pack("<IH", VERSION, len(name)), name, struct.pack("<HHffffI", r["grid_w"], r["grid_h"], r["threshold"], r["w_ncc"], r["w_struct"], r["w_aspect"], len(rows))]
    for r in rows:
        if len(r["bitmap"]) != r["grid_w"] * r["grid_h"]:
            raise ValueError(f"prototype {r['proto_no']}: the bitmap has {len(r['bitmap'])} cells")
        byte = lambda v: min(255, max(0, v))
        out += [struct.pack("<IBBBxfI", r["codepoint"], byte(r["holes"]), byte(r["endpoints"]), byte(r["junctions"]), r["aspect"], len(r["bitmap"])), bytes(r["bitmap"])]
    return b"".join(out)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """A partition per file: the path itself, or every pack file of a folder; ``ids`` picks some by name."""
        at, path = store(self.options["path"])
        if at.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        wanted = [f"{x}{SUFFIX}" for x in self.options.get("ids", "").split(",") if x]
        return [_File(f"{path}/{f}") for f in wanted or sorted(x.base_name for x in at.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(SUFFIX))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with store(self.options["path"])[0].open_input_stream(partition.path, compression=None) as f:
            data = f.read()
        try:
            yield from parse(data)
        except ValueError as e:
            raise ValueError(f"{partition.path}: {e}") from None


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """Tasks write their rows side by side; only on commit are they put together, a file per pack, whichever tasks its rows came
    from.  Of a task that ran twice one part is committed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        at, path = store(self.path)
        at.create_dir(f"{path}/{PARTS}")
        own = f"{path}/{PARTS}/{uuid.uuid4().hex}.parquet"
        schema = pa.schema([("pack_id", pa.string()), *((c, pa.int64()) for c in ("grid_w", "grid_h")), *((c, pa.float32()) for c in ("threshold", "w_ncc", "w_struct", "w_aspect")), *((c, pa.int64()) for c in ("proto_no", "codepoint", "holes", "endpoints", "junctions")), ("aspect", pa.float32()), ("bitmap", pa.binary())])
        with pq.ParquetWriter(own, schema, filesystem=at) as out:
            while held := list(islice(rows, 4096)):
                out.write_table(pa.Table.from_pylist([{c: bytes(r[c]) if c == "bitmap" else r[c] for c in schema.names} for r in held], schema))
        return _Part(own)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Packs are a few hundred kilobytes each and are put together one at a time."""
        at, path = store(self.path)
        if self.overwrite:
            for x in at.get_file_info(fs.FileSelector(path)):
                if x.base_name.endswith(SUFFIX):
                    at.delete_file(x.path)
        parts = [m.path for m in messages if m is not None]
        names = {x for p in parts for x in pq.read_table(p, columns=["pack_id"], filesystem=at).column(0).unique().to_pylist()}
        for name in sorted(names):
            rows = [r for p in parts for r in pq.read_table(p, filesystem=at, filters=[("pack_id", "=", name)]).to_pylist()]
            with at.open_output_stream(f"{path}/{PARTS}/{name}{SUFFIX}", compression=None) as f:
                f.write(build(rows))
            at.move(f"{path}/{PARTS}/{name}{SUFFIX}", f"{path}/{name}{SUFFIX}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        at, path = store(self.path)
        if at.get_file_info(f"{path}/{PARTS}").type == fs.FileType.Directory:
            at.delete_dir(f"{path}/{PARTS}")


class GlyphPacks(DataSource):
    """format("glyphpack"): load a file or folder, or save rows of SCHEMA into a folder."""

    @classmethod
    def name(cls) -> str:
        return "glyphpack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GlyphPacks)


def rows_of(pack) -> list[tuple]:
    """Rows of SCHEMA from a pack in memory."""
    return [(pack.id, pack.grid_w, pack.grid_h, float(pack.threshold), *map(float, pack.weights), i, int(cp), *map(int, s[:3]), float(s[3]), (b * 255).astype("uint8").tobytes()) for i, (cp, s, b) in enumerate(zip(pack.points, pack.shapes, pack.bitmaps, strict=True))]
