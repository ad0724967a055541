"""python -m scriptorium.jobs.full_circle [LANG...] [--corpora DIR] [--strict] [--json]: draw a sample of each language, recognise
it, and report whether the language, and with --strict the text, comes back.

A sample is the first line of <lang>/corpus.txt below a folder, or else the registry's sample letter.  English is drawn in the
terminal font, others in an installed font; a language that it has no letters of is reported as not drawn."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import font, registry
from scriptorium.functions.cluster import ship
from scriptorium.operators import detect, ocr
from scriptorium.sources import images


def report(spark: SparkSession, langs: list[str], corpora: str | None = None, strict: bool = False) -> DataFrame:
    """A row per language, as ``detect.circle`` gives them, and its name."""
    samples = {x[0]: x[5] for x in registry.LANGUAGES if x[0] in langs}
    if corpora:
        first = images.read_corpora(spark, corpora).where((F.col("line_no") == 1) & F.col("lang").isin(langs))
        samples |= {r.lang: r.text for r in first.collect()}  # 21 rows at most
    known = {x: ocr.latin_pack() if x == "en" else ocr.drawn_pack(spark, registry.PACK_OF[x]) for x in samples}
    path = font.find_font()
    made = font.JvmFont(spark, path) if path else None
    rows = []
    for k, (lang, sample) in enumerate(samples.items()):
        rtl = next(p[9] for p in registry.PACKS if p[0] == registry.PACK_OF[lang])
        a = font.drawn(sample) if lang == "en" else made.draw(sample, rtl=rtl) if known[lang] else None
        rows.append((k, lang, sample, 0 if a is None else a.shape[1], 0 if a is None else a.shape[0], None if a is None else bytearray(a.tobytes())))
    drawn = spark.createDataFrame(rows, "image_id long, lang string, sample_text string, width int, height int, pixels binary")
    found = detect.detect_drawn(drawn, [p for p in known.values() if p], "sample_text")
    out = detect.circle(found, drawn, strict)
    lost = found.where("error IS NOT NULL").select("image_id").withColumn("lost", F.lit(True))
    out = out.join(lost, "image_id", "left").withColumn("detail", F.when(F.col("lost"), "not drawn").otherwise(F.col("detail"))).withColumn("ok", F.col("ok") & F.col("lost").isNull()).drop("lost")
    return out.join(F.broadcast(registry.languages(spark).select(F.col("code").alias("lang"), "name", "seq")), "lang").orderBy("seq").drop("seq", "image_id")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("langs", nargs="*", default=list(registry.CODES))
    p.add_argument("--corpora")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    rows = report(spark, a.langs, a.corpora, a.strict)
    if a.json:
        print("\n".join(r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()))
    else:
        rows.show(50, False)
    done = rows.collect()
    print(f"{sum(r.ok for r in done)} of {len(done)} passed")
    return int(any(not r.ok and r.detail != "not drawn" for r in done))


if __name__ == "__main__":
    raise SystemExit(main())
