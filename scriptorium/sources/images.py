"""Images and corpora as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import font, pixels, registry
from scriptorium.operators import text as T

GREY = "image_id long, path string, width int, height int, pixels binary, error string, code int"


def parse_pnm(data: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, channels, samples) of a binary grey or colour map (P5, P6); comments are skipped, the largest value
    is read and ignored.  ValueError for anything else, or if samples are missing."""
    channels = {b"P5": 1, b"P6": 3}.get(data[:2])
    if channels is None:
        raise ValueError("neither P5 nor P6")
    at, numbers = 2, []
    while len(numbers) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) if data[at : at + 1] == b"#" else at + 1
            if at < 0:
                raise ValueError("the header is cut off")
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad header")
        numbers.append(int(data[at:end]))
        at = end
    width, height, _ = numbers
    need = width * height * channels
    if width <= 0 or height <= 0 or len(data) < at + 1 + need:
        raise ValueError("samples are missing")
    return width, height, channels, data[at + 1 : at + 1 + need]


def _grey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, path, w, h, channels, data, order in zip(*(b.column(c).to_pylist() for c in ("image_id", "path", "width", "height", "channels", "data", "order")), strict=True):
            row = {"image_id": key, "path": path, "width": None, "height": None, "pixels": None, "error": None, "code": registry.OK}
            try:
                row["code"] = registry.NOT_LOADED
                if order == "PNM":
                    w, h, channels, data = parse_pnm(data or b"")
                elif path is None:
                    row["code"] = registry.NOTHING
                if not data or not w or not h or w <= 0 or h <= 0 or len(data) < w * h * channels:
                    raise ValueError("no samples, or no size")
                row |= {"width": w, "height": h, "pixels": pixels.grey(data, w, h, channels, "RGB" if order == "PNM" else order).tobytes(), "code": registry.OK}
            except ValueError as e:
                row["error"] = str(e)
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.int64()), ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string()), ("code", pa.int32())]))


def from_samples(df: DataFrame, *, id_col: str, width: str, height: str, channels, data: str, order: str = "RGB", path_col: str | None = None) -> DataFrame:
    """Grey images from rows of raw samples; what has none, or no size, gets an ``error`` and a
    code below 0."""
    channels = F.col(channels) if isinstance(channels, str) else F.lit(channels)
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("image_id"), path.alias("path"), F.col(width).cast("int").alias("width"), F.col(height).cast("int").alias("height"), channels.cast("int").alias("channels"), F.col(data).alias("data"), F.lit(order).alias("order"))
    return rows.mapInArrow(_grey, GREY)


def from_pnm(df: DataFrame, id_col: str, content_col: str, path_col: str | None = None) -> DataFrame:
    """Grey images from rows that hold P5 and P6 files."""
    none, path = F.lit(None).cast("int"), F.col(path_col) if path_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("image_id"), path.alias("path"), none.alias("width"), none.alias("height"), none.alias("channels"), F.col(content_col).alias("data"), F.lit("PNM").alias("order"))
    return rows.mapInArrow(_grey, GREY)


def read_pnm(spark: SparkSession, path: str, glob: str = "*.p[gp]m") -> DataFrame:
    """Grey images from P5 and P6 files; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return from_pnm(files.withColumn("id", F.xxhash64("path")), "id", "content", "path")


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Grey images from PNG, JPEG and BMP files, by Spark's image source (whose channels are blue, green, red)."""
    found = spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*")
    rows = found.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data", F.lit("BGR").alias("order"))
    return rows.mapInArrow(_grey, GREY)


def read_corpora(spark: SparkSession, path: str, glob: str = "corpus.txt") -> DataFrame:
    """lang, line_no, text: the stripped lines that aren't blank of <lang>/corpus.txt below a folder."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    lines = whole.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("lang"), F.posexplode(T.lines_of("value")).alias("line_no", "line"))
    return lines.select("lang", F.col("line_no") + 1, T.stripped("line").alias("text")).toDF("lang", "line_no", "text")


def with_file(images: DataFrame, kind: str, out: str = "content") -> DataFrame:
    """Add each grey image as the bytes of a PNG or BMP file."""
    make = {"png": font.as_png, "bmp": font.as_bmp}[kind]

    def run(width: pa.Array, height: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(width.to_pylist(), height.to_pylist(), data.to_pylist(), strict=True)
        return pa.array([make(np.frombuffer(x, np.uint8).reshape(h, w)) if x and w and h else None for w, h, x in rows], pa.binary())

    return images.withColumn(out, F.arrow_udf(run, "binary")("width", "height", "pixels"))


def with_pgm(images: DataFrame, out: str = "content") -> DataFrame:
    """Add each grey image as the bytes of a P5 file."""
    head = F.concat(F.lit("P5\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    return images.withColumn(out, F.concat(F.encode(head, "US-ASCII"), F.col("pixels")))
