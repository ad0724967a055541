"""Where jobs of this subpackage cut lineage: the folder all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scriptorium.functions.names import fresh as fresh


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() write to ``spark.checkpoint.dir``; only where that is unset, as in local tests, to a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)


def written(table: DataFrame) -> DataFrame:
    """The table, written to the checkpoint folder.  Spark deletes the shuffle files that only its making needed once the driver's
    garbage collector has met them; that is asked for here, as it might not come for long."""
    out = table.checkpoint()
    table.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return out


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, for written tables."""
    use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def whole_ids(table: DataFrame, column: str) -> Column:
    """The ids as long; refused here, before any job starts, if they aren't whole numbers."""
    kind = table.select(F.col(column)).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} must be a whole number, not {kind.simpleString()}")
    return F.col(column).cast("long")


def with_fields(table: DataFrame, columns: list[str], ddl: str) -> T.StructType:
    """The schema of some columns as they are, and further fields."""
    return T.StructType([table.schema[c] for c in columns] + T.StructType.fromDDL(ddl).fields)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a written table that is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
