"""Files from rows, in a folder that all executors reach."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def store(path: str) -> tuple[fs.FileSystem, str]:
    """A path or URI as a file system and a path in it."""
    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def scratch(spark: SparkSession) -> str:
    """A folder for files that are written and read again: that of checkpoints; only in local mode without one a new one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="files-")
    return folder


def save(df: DataFrame, folder: str, name_col: str, content_col: str) -> None:
    """A file for each row, named by ``name_col``, below a folder; a name may hold folders.  A file is written under another
    name and moved, so a task that runs twice leaves it whole."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, top = store(folder)
        for b in batches:
            for name, content in zip(b.column("name"), b.column("content"), strict=True):
                path = f"{top}/{name.as_py()}"
                to.create_dir(os.path.dirname(path))
                part = f"{path}.{os.getpid()}.part"
                with to.open_output_stream(part, compression=None) as out:
                    out.write(content.as_py() or b"")
                to.move(part, path)
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    df.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content")).mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
