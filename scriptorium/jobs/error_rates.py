"""python -m scriptorium.jobs.error_rates CORPORA [LANG...]: draw every line of <lang>/corpus.txt, recognise it, and report
error rates on the recognised text against the budgets.  English is drawn in the terminal font, others in an installed font."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import font, registry
from scriptorium.functions.cluster import ship
from scriptorium.operators import detect, ocr
from scriptorium.sources import images


def letters(spark: SparkSession, langs: list[str], most: int = 40) -> DataFrame:
    """The same over single letters of the languages' ranges, as many as an installed font has, each drawn as a page."""
    made = font.JvmFont(spark, font.find_font()) if font.find_font() else None
    rows, known = [], [ocr.latin_pack()]
    for lang in langs if made else []:
        own = ocr.drawn_pack(spark, registry.PACK_OF[lang], ligatures=False)
        if own is None:
            continue
        known.append(own)
        for cp, a in zip(own.points, made.draw_all([chr(cp) for cp in own.points[:most]]), strict=False):
            rows.append((len(rows), lang, chr(cp), a.shape[1], a.shape[0], bytearray(a.tobytes())))
    drawn = spark.createDataFrame(rows, "image_id long, lang string, sample_text string, width int, height int, pixels binary").repartition(2 * spark.sparkContext.defaultParallelism)
    return detect.corpus_report(detect.detect_drawn(drawn, known, "sample_text"), drawn)


def report(spark: SparkSession, path: str, langs: list[str]) -> DataFrame:
    lines = images.read_corpora(spark, path).where(F.col("lang").isin(langs)).withColumn("image_id", F.xxhash64("lang", "line_no")).withColumnRenamed("text", "sample_text")
    known = [m for m in (ocr.latin_pack() if x == "en" else ocr.drawn_pack(spark, registry.PACK_OF[x]) for x in langs) if m]
    drawn = ocr.draw_terminal(lines.where("lang = 'en'"), "sample_text").join(lines.select("image_id", "sample_text"), "image_id")
    made = font.JvmFont(spark, font.find_font()) if font.find_font() else None
    rows = []
    for r in lines.where("lang <> 'en'").collect() if made else []:  # corpora: a few hundred short lines, drawn by the driver's JVM
        a = made.draw(r["sample_text"], rtl=next(p[9] for p in registry.PACKS if p[0] == registry.PACK_OF[r["lang"]]))
        rows.append((r["image_id"], a.shape[1], a.shape[0], bytearray(a.tobytes()), r["sample_text"]))
    drawn = drawn.unionByName(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, sample_text string"))
    return detect.corpus_report(detect.detect_drawn(drawn, known, "sample_text"), lines)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("corpora")
    p.add_argument("langs", nargs="*", default=["en"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    out = report(spark, a.corpora, a.langs).orderBy("lang")
    out.show(50, False)
    return int(out.where("not passed").count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
