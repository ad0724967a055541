"""python -m scriptorium.jobs.build_packs OUT [PACK...] [--font FILE]: write glyph pack files, the Latin one from the terminal
font, others from an installed font that has the script's letters."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from scriptorium.functions.cluster import ship
from scriptorium.operators import ocr
from scriptorium.sources import packs


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("out")
    p.add_argument("packs", nargs="*", default=["latin"])
    p.add_argument("--font")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    packs.register(spark)
    made = [ocr.latin_pack() if x == "latin" else ocr.drawn_pack(spark, x, a.font) for x in a.packs]
    rows = [r for m in made if m for r in packs.rows_of(m)]
    spark.createDataFrame(rows, packs.SCHEMA).repartition("pack_id").write.format("glyphpack").mode("append").save(a.out)
    for name, m in zip(a.packs, made, strict=True):
        print(name, len(m.points) if m else "no such font, or it lacks the letters")


if __name__ == "__main__":
    main()
