"""Languages of images: recognised text, or a hint's script where nothing is recognised, and reports on both.

Each result says where it comes from.  ``fallback_used`` tells apart a text that was recognised from a hint that stood in
for it, and reports compare ``ocr_text``, so that an empty recognition never passes for a perfect one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import registry
from scriptorium.operators import ocr, text as T


def _result(df: DataFrame, source: Column, instead: Column, ocr_text: Column) -> DataFrame:
    """image_id, text, languages, mean_confidence, glyph_count, ocr_text, identification_source, fallback_used, error, code."""
    chosen = df.withColumns({"fallback_used": instead, "identification_source": source, "kept_text": ocr_text})
    chosen = chosen.withColumn("text", F.when(F.col("fallback_used"), F.col("hint")).otherwise(F.col("ocr_text")))
    return T.detect_languages(chosen).select("image_id", "text", "languages", "mean_confidence", "glyph_count", F.col("kept_text").alias("ocr_text"), "identification_source", "fallback_used", "error", "code")


def detect_images(images: DataFrame, packs: list[ocr.Pack], hint_col: str | None = None, route_by_hint: bool = True, hybrid: bool = True, **options) -> DataFrame:
    """Results for grey images.  A hint's letters choose the pack (``route_by_hint``) and stand in for a text that can't be
    read: then the source is unicode, else hybrid; without a hint that has a letter it is ocr.  Samples in memory, as against
    files, go without ``route_by_hint`` and ``hybrid``: what is read is ocr whatever the hint."""
    hint = T.stripped(F.col(hint_col)) if hint_col else F.lit(None).cast("string")
    rows = images.withColumn("hint", hint).withColumn("hint_profile", T.profile("hint"))
    if route_by_hint and hint_col:
        rows = rows.withColumn("pack_hint", F.col("hint_profile.pack_id"))
    read = ocr.read_text(rows, packs, keep=("hint", "hint_profile"), **options)
    source = T.identification(F.col("ocr_text"), F.col("hint"), F.col("hint_profile"))
    source = source if hybrid else F.when(source == "unicode", source).otherwise("ocr")
    return _result(read, source, source == "unicode", F.when(source == "unicode", "").otherwise(F.col("ocr_text")))


def detect_drawn(images: DataFrame, packs: list[ocr.Pack], text_col: str, **options) -> DataFrame:
    """Results for images drawn from a known text: where packs cover its script the source is ocr even if the text had to
    stand in; where they don't it is unicode, and what was recognised is kept beside it."""
    rows = images.withColumn("hint", T.stripped(F.col(text_col))).withColumn("hint_profile", T.profile("hint"))
    rows = rows.withColumn("pack_hint", F.col("hint_profile.pack_id"))
    read = ocr.read_text(rows, packs, keep=("hint", "hint_profile"), **options)
    native, letter, blank = F.col("hint_profile.native_ocr"), F.col("hint_profile.has_letter"), T.is_blank(F.col("ocr_text"))
    instead = ~native | blank & letter
    return _result(read, F.when(native, "ocr").otherwise("unicode"), instead, F.when(native & instead, "").otherwise(F.col("ocr_text")))


def circle(results: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """results joined with expected (image_id, lang, sample_text): whether the first language is the expected one and, if
    ``strict``, whether the recognised text is the sample after folding."""
    first = F.get("languages", F.lit(0))
    joined = results.join(expected.select("image_id", "lang", "sample_text"), "image_id")
    rows = joined.withColumns({"detected_code": F.coalesce(first["code"], F.lit("")), "detected_name": F.coalesce(first["name"], F.lit("")), "percent": F.coalesce(first["percent"], F.lit(0)), "a": T.folded("ocr_text"), "b": T.folded("sample_text")})
    same = (F.col("a") == F.col("b")) & ~F.col("fallback_used") if strict else F.lit(True)
    right = F.col("detected_code") == F.col("lang")
    detail = F.when(~right, "language differs").when(~same, "text differs").otherwise("language match")
    return rows.select("image_id", "lang", "sample_text", "ocr_text", "detected_code", "detected_name", "percent", "mean_confidence", "glyph_count", "identification_source", "fallback_used", (right & same).alias("ok"), detail.alias("detail"))


def corpus_report(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Error rates by language on recognised text, against the budgets."""
    joined = results.join(expected.select("image_id", "lang", "sample_text"), "image_id").select("lang", T.folded("sample_text").alias("a"), T.folded("ocr_text").alias("b"))
    rate = T.error_rate(joined, ["lang"], "a", "b")
    budget = F.broadcast(registry.budgets(results.sparkSession))
    limit = F.coalesce("max_cer", F.lit(0.05))
    return rate.join(budget, rate.lang == budget.code, "left").select("lang", "strings", "failures", "errors", "chars", "cer", limit.alias("max_cer"), (F.col("cer") <= limit).alias("passed"))
