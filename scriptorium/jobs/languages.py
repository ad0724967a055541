"""python -m scriptorium.jobs.languages list [--code XX] [--json] | text IN OUT [--column text] | images IN OUT [--packs DIR]

list prints the registry; text reads Parquet and writes JSON lines with each row's result; images reads a folder of P5 and P6
files, or of PNG, JPEG and BMP files with --format image, and writes JSON lines with what was recognised.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from scriptorium.functions import registry
from scriptorium.functions.cluster import ship
from scriptorium.operators import detect, ocr, text as T
from scriptorium.sources import images, packs


def as_dict(x: tuple) -> dict:
    code, name, script, regions, ranges, sample, _ = x
    return {"code": code, "name": name, "script": script, "regions": list(regions), "unicode_ranges": [{"start": f"U+{a:04X}", "end": f"U+{b:04X}"} for a, b in ranges], "sample_char": sample, "ocr_native": True, "script_detection": True}


def listed(code: str | None, as_json: bool) -> str:
    rows = [x for x in registry.LANGUAGES if code is None or x[0] == code.lower()]
    if not rows:
        raise SystemExit(f"Unknown language code: {code}")
    if as_json:
        return json.dumps([as_dict(x) for x in rows] if code is None else as_dict(rows[0]), ensure_ascii=False, indent=2)
    return "\n".join([f"{'Code':<4}  {'Language':<11}  {'Script':<29}  OCR", *(f"{x[0]:<4}  {x[1]:<11}  {x[2]:<29}  yes" for x in rows)])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("what", choices=("list", "text", "images"))
    p.add_argument("paths", nargs="*")
    p.add_argument("--code")
    p.add_argument("--json", action="store_true")
    p.add_argument("--column", default="text")
    p.add_argument("--format", choices=("pnm", "image"), default="pnm")
    p.add_argument("--packs", help="a folder of glyph packs; without it the Latin terminal pack")
    a = p.parse_args(argv)
    if a.what == "list":
        print(listed(a.code, a.json))
        return
    source, target = a.paths
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if a.what == "text":
        out = T.result(spark.read.parquet(source), a.column).select(F.to_json("result").alias("value"))
    else:
        known = [ocr.latin_pack()]
        if a.packs:
            packs.register(spark)
            known = ocr.packs_from(spark.read.format("glyphpack").load(a.packs))
        read = images.read_pnm(spark, source) if a.format == "pnm" else images.read_images(spark, source)
        out = detect.detect_images(read, known).select(F.to_json(F.struct("*")).alias("value"))
    out.write.text(target)


if __name__ == "__main__":
    main()
