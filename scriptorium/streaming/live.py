"""The text operators over streams: all are stateless by row, so they only need a stream for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scriptorium.operators import text as T


def languages(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their ranked languages."""
    return T.detect_languages(stream, text_col)


def results(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a result as JSON, for a sink of lines."""
    return T.result(stream, text_col).withColumn("json", F.to_json("result")).drop("result")


def language_mix(stream: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Letters by language in windows of event time; rows later than ``late`` are not waited for."""
    rows = stream.withWatermark(time_col, late).select(F.col(time_col).alias("at"), T.profile(text_col)["counts"].alias("c"))
    long = rows.select("at", F.posexplode_outer("c").alias("k", "n")).where("n > 0")  # outer: see T.letter_counts
    codes = F.array(*(F.lit(c) for c in T.registry.CODES))
    return long.groupBy(F.window("at", window).alias("window"), F.element_at(codes, F.col("k") + 1).alias("code")).agg(F.sum("n").cast("long").alias("letters"))
