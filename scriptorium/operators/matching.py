"""The relational half of recognition: glyphs, prototypes, scores and lines as DataFrames.

These say with joins, aggregates and windows what the narrow stage in ``ocr`` does page by page; they serve where glyphs or
scores are already in tables.  Prototypes and packs are dimension tables of fixed, small size and are broadcast; every
window and group is a line or an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import registry
from scriptorium.functions.names import fresh
from scriptorium.operators.text import character


def overlap(a: Column, b: Column) -> Column:
    """Bits in both over bits in either of two bit sets (arrays of long); 0 if there are none."""
    count = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda acc, x: acc + F.bit_count(x))
    either = count(lambda x, y: x.bitwiseOR(y))
    return F.when(either > 0, count(lambda x, y: x.bitwiseAND(y)) / either).otherwise(0.0)


def likeness(glyph: str, proto: str) -> Column:
    """1 less a quarter of the differences of holes / 4, ends / 8, forks / 8 and aspect / 2; at least 0.  Column prefixes."""
    off = lambda c, n: F.abs(F.col(f"{glyph}{c}") - F.col(f"{proto}{c}")) / n
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.25) * (off("holes", 4) + off("endpoints", 8) + off("junctions", 8) + off("aspect", 2)))


def aspect_likeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(a - b))


def fused(packs_prefix: str, ncc: Column, struct: Column, aspect: Column) -> Column:
    w = lambda c: F.col(f"{packs_prefix}{c}")
    return w("w_ncc") * ncc + w("w_struct") * struct + w("w_aspect") * aspect


def best_match(scored: DataFrame, keys: list[str], threshold: Column | None = None) -> DataFrame:
    """keys, codepoint, confidence: the prototype with the highest score, of equal ones the lowest code point; the code point
    is that of "?" below the threshold."""
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("codepoint", "score"), F.struct("score", -F.col("codepoint"))).alias("b"), *([F.max(threshold).alias("t")] if threshold is not None else []))
    point = F.col("b.codepoint") if threshold is None else F.when(F.col("b.score") < F.col("t"), ord("?")).otherwise(F.col("b.codepoint"))
    return best.select(*keys, point.alias("codepoint"), F.col("b.score").alias("confidence"))


def match_prototypes(glyphs: DataFrame, prototypes: DataFrame, packs: DataFrame, keys: list[str]) -> DataFrame:
    """glyphs: keys, pack_id, bits, holes, endpoints, junctions, aspect; prototypes: pack_id, codepoint and the same."""
    g = glyphs.select(*keys, "pack_id", *(F.col(c).alias(f"g_{c}") for c in ("bits", "holes", "endpoints", "junctions", "aspect")))
    p = prototypes.select("pack_id", "codepoint", *(F.col(c).alias(f"p_{c}") for c in ("bits", "holes", "endpoints", "junctions", "aspect")))
    joined = g.join(F.broadcast(p), "pack_id").join(F.broadcast(packs.select("pack_id", "threshold", "w_ncc", "w_struct", "w_aspect")), "pack_id")
    score = fused("", overlap(F.col("g_bits"), F.col("p_bits")), likeness("g_", "p_"), aspect_likeness(F.col("g_aspect"), F.col("p_aspect")))
    return best_match(joined.withColumn("score", score), [*keys, "pack_id"], F.col("threshold"))


def route(scores: DataFrame, line_keys: list[str], sample: int = 5) -> DataFrame:
    """scores: line_keys, glyph_no, pack_id, confidence, and if there is one pack_hint of the line.  The pack of each line by
    its first glyphs' mean scores: the best other than latin from 0.20 on if it leads latin by over 0.10, else latin from
    0.15 on, else the best other; a hint decides alone."""
    first = scores.withColumn("k", F.dense_rank().over(Window.partitionBy(*line_keys).orderBy("glyph_no"))).where(F.col("k") <= sample)
    seq = F.create_map(*[F.lit(x) for i, p in enumerate(registry.PACKS) for x in (p[0], i)])
    hint = [F.max("pack_hint").alias("hint")] if "pack_hint" in scores.columns else []
    mean = first.groupBy(*line_keys, "pack_id").agg(F.avg("confidence").alias("mean"), *hint)
    other = F.when(F.col("pack_id") != "latin", F.struct("mean", (-F.coalesce(seq[F.col("pack_id")], F.lit(99))).alias("s"), "pack_id"))
    per = mean.groupBy(*line_keys).agg(F.max(other).alias("o"), F.max(F.when(F.col("pack_id") == "latin", F.col("mean"))).alias("l"), *([F.max("hint").alias("hint")] if hint else []))
    latin, best = F.coalesce("l", F.lit(-1.0)), F.coalesce("o.mean", F.lit(-1.0))
    chosen = F.when((best >= 0.20) & (best > latin + 0.10), F.col("o.pack_id")).when(latin >= 0.15, "latin").otherwise(F.coalesce("o.pack_id", F.lit("cyrillic")))
    return per.select(*line_keys, (F.coalesce("hint", chosen) if hint else chosen).alias("pack_id"))


def with_fallback(matches: DataFrame, others: DataFrame, packs: DataFrame, keys: list[str]) -> DataFrame:
    """matches: keys, pack_id, codepoint, confidence of the line's pack; others: the same for all packs.  A match below its
    pack's threshold gives way to the best of the other packs if that is strictly better; the sure ones are not joined."""
    limits = F.broadcast(packs.select("pack_id", "threshold"))
    seq = F.create_map(*[F.lit(x) for i, p in enumerate(registry.PACKS) for x in (p[0], i)])
    known = matches.join(limits, "pack_id", "left").withColumn("sure", F.col("confidence") >= F.coalesce("threshold", F.lit(0.0)))
    unsure = known.where(~F.col("sure")).select(*keys, F.col("pack_id").alias("own"))
    best = others.join(unsure, keys).where("pack_id <> own").groupBy(*keys).agg(F.max_by(F.struct("pack_id", "codepoint", "confidence"), F.struct("confidence", -F.coalesce(seq[F.col("pack_id")], F.lit(99)))).alias("b"))
    joined = known.join(best, keys, "left")
    better = ~F.col("sure") & (F.col("b.confidence") > F.col("confidence"))
    pick = lambda c: F.when(better, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*keys, pick("pack_id"), pick("codepoint"), pick("confidence"))


def calibrated(df: DataFrame, packs: DataFrame) -> DataFrame:
    """confidence to a * confidence + b within 0 and 1, by the winning pack; unknown packs leave it."""
    joined = df.join(F.broadcast(packs.select("pack_id", "cal_a", "cal_b")), "pack_id", "left")
    line = F.coalesce("cal_a", F.lit(1.0)) * F.col("confidence") + F.coalesce("cal_b", F.lit(0.0))
    return joined.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), line))).drop("cal_a", "cal_b")


def oversized(w: Column, h: Column) -> Column:
    """Whether a box is no letter."""
    return (w > 120) & (w > 2 * h)


def ligatures(df: DataFrame, line_keys: list[str], order: str = "glyph_no", point: str = "codepoint") -> DataFrame:
    """line_keys and ``points``: the line's code points in order, pairs that form a ligature replaced from left to right.  A
    fold over the line, as what pairs depends on what has paired."""
    pairs = F.create_map(*[F.lit(x) for a, b, c in registry.LIGATURES for x in (f"{a},{b}", c)])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, point))), lambda x: x[point])
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        joint = F.when(acc["open"] >= 0, pairs[F.concat_ws(",", acc["open"], x)])
        plain = F.when(acc["open"] >= 0, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"])
        return F.struct(F.when(joint.isNotNull(), F.array_append(acc["out"], joint)).otherwise(plain).alias("out"), F.when(joint.isNotNull(), F.lit(-1)).otherwise(x.cast("int")).alias("open"))

    folded = F.aggregate("p", start, step, lambda acc: F.when(acc["open"] >= 0, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"]))
    return df.groupBy(*line_keys).agg(ordered.alias("p")).select(*line_keys, folded.alias("points"))


def spelt(glyphs: DataFrame, image_keys: list[str], order: list[str]) -> DataFrame:
    """image_keys, ocr_text, mean_confidence, glyph_count from rows with x, w, codepoint and confidence: characters in order,
    a space where the gap to the glyph before, also across lines, is wider than the narrower of the two and than 4."""
    by = Window.partitionBy(*image_keys).orderBy(*order)
    gap = F.col("x") - (F.lag("x").over(by) + F.lag("w").over(by))
    space = F.coalesce(gap > F.greatest(F.least(F.lag("w").over(by), F.col("w")), F.lit(4)), F.lit(False))
    sign = F.when(F.col("codepoint").isin(0, ord("?")), "").otherwise(character("codepoint"))
    rows = glyphs.withColumn("piece", F.concat(F.when(space, " ").otherwise(""), sign))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy(*image_keys).agg(text.alias("ocr_text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count("*").cast("int").alias("glyph_count"))


def right_to_left(glyphs: DataFrame, packs: DataFrame, line_keys: list[str], order: str = "glyph_no") -> DataFrame:
    """Number the glyphs of lines of right-to-left packs from the other end."""
    joined = glyphs.join(F.broadcast(packs.select("pack_id", "rtl")), "pack_id", "left")
    last = F.max(order).over(Window.partitionBy(*line_keys))
    return joined.withColumn(order, F.when(F.coalesce("rtl", F.lit(False)), last - F.col(order)).otherwise(F.col(order))).drop("rtl")


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The element in the middle of the sorted values, the upper one of two: exact, by rank in the group."""
    by = Window.partitionBy(*keys)
    ranked = df.select(*keys, value, F.row_number().over(by.orderBy(value)).alias("i"), F.count("*").over(by).alias("n"))
    return ranked.where("i = floor(n / 2) + 1").select(*keys, F.col(value).alias(out))


def distinct_prototypes(prototypes: DataFrame, order: str = "proto_no") -> DataFrame:
    """Of a pack's prototypes with one bitmap the first."""
    return prototypes.withColumn("i", F.row_number().over(Window.partitionBy("pack_id", "bitmap").orderBy(order))).where("i = 1").drop("i")


def pixel_rows(images: DataFrame) -> DataFrame:
    """image_id, y, x, v for each pixel of small grey images (for reports; recognition works on arrays)."""
    rows = images.select("image_id", "width", F.posexplode(F.split(F.decode("pixels", "ISO-8859-1"), "")).alias("i", "c"))
    return rows.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.ascii("c").alias("v"))


def histogram(pixel_table: DataFrame) -> DataFrame:
    return pixel_table.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def otsu(histograms: DataFrame) -> DataFrame:
    """image_id, threshold: the first one with the largest variance between the classes; 128 if there is only one."""
    by = Window.partitionBy("image_id")
    run = by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    t = histograms.select("image_id", "v", F.sum("n").over(run).alias("below"), F.sum("n").over(by).alias("total"), F.sum(F.col("v") * F.col("n")).over(run).alias("mass"), F.sum(F.col("v") * F.col("n")).over(by).alias("whole"))
    above = F.col("total") - F.col("below")
    step = F.col("mass") / F.col("below") - (F.col("whole") - F.col("mass")) / above
    t = t.withColumn("between", F.when(above > 0, F.col("below").cast("double") * above * step * step).otherwise(0.0))
    return t.groupBy("image_id").agg(F.max_by(F.when(F.col("between") > 0, F.col("v")), F.struct("between", -F.col("v"))).alias("v")).select("image_id", F.coalesce("v", F.lit(128)).alias("threshold"))


def ink_by_row(pixel_table: DataFrame, ink: Column) -> DataFrame:
    return pixel_table.groupBy("image_id", "y").agg(F.count_if(ink).alias("ink"))


def bands(rows: DataFrame, least_height: int = 4) -> DataFrame:
    """image_id, y0, y1: runs of rows with ink from a twentieth of the most on; gaps and islands by difference of ranks."""
    by = Window.partitionBy("image_id")
    kept = rows.withColumn("most", F.max("ink").over(by)).where(F.col("ink") >= F.greatest(F.lit(1), F.floor(F.col("most") / 20)))
    island = F.col("y") - F.row_number().over(by.orderBy("y"))
    runs = kept.withColumn("g", island).groupBy("image_id", "g").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return runs.where(F.col("y1") - F.col("y0") >= least_height).select("image_id", "y0", "y1")


def packs(spark: SparkSession) -> DataFrame:
    return registry.packs(spark)


#: When a box g joins the box p before it, as grown so far; gap and overlap are along the line, line_h is the line's height.
JOINS = {
    "marks": "(g.h <= greatest(4, line_h div 3) or g.w <= greatest(3, g.h div 2)) and (gap <= 4 or overlap > 0) and abs(p.y - g.y) <= greatest(p.h, g.h)",
    "touching": "abs(p.y - g.y) <= greatest(4, (p.h + g.h) div 2 div 2) and (gap <= greatest(6, p.w div 4) or overlap > 0)",
    "near": "(gap <= greatest(2, (p.w + g.w) div 2 div 8) and abs(p.y - g.y) <= (p.h + g.h) div 2 div 2) or (overlap > greatest(1, (p.w + g.w) div 2 div 3) and abs(p.y + p.h - g.y) <= greatest(2, (p.h + g.h) div 2 div 4))",
}


def merged_boxes(boxes: DataFrame, line_keys: list[str], rule: str, order: str = "glyph_no") -> DataFrame:
    """line_keys, box_no, x, y, w, h, parts: the boxes of each line, left to right, joined by one of ``JOINS``.  A fold over the
    line, as what joins depends on what has joined."""
    box = "struct<x:int,y:int,w:int,h:int,parts:int>"
    row, tall = fresh([*line_keys, "box_no"], "line", "line_h")
    line = F.array_sort(F.collect_list(F.struct(order, F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"), F.lit(1).alias("parts")).alias("g"))))
    held = boxes.groupBy(*line_keys).agg(F.transform(line, lambda x: x["g"]).alias(row), F.greatest(F.max(F.col("y") + F.col("h")), F.max("h")).cast("int").alias(tall))
    test = JOINS[rule].replace("line_h", tall).replace("gap", "(g.x - p.x - p.w)").replace("overlap", "(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x))").replace("p.", "acc.open.")
    grown = "named_struct('x', least(acc.open.x, g.x), 'y', least(acc.open.y, g.y), 'w', greatest(acc.open.x + acc.open.w, g.x + g.w) - least(acc.open.x, g.x), 'h', greatest(acc.open.y + acc.open.h, g.y + g.h) - least(acc.open.y, g.y), 'parts', acc.open.parts + 1)"
    step = f"if(acc.open is null, named_struct('out', acc.out, 'open', g), if({test}, named_struct('out', acc.out, 'open', {grown}), named_struct('out', array_append(acc.out, acc.open), 'open', g)))"
    folded = f"aggregate({row}, named_struct('out', cast(array() as array<{box}>), 'open', cast(null as {box})), (acc, g) -> {step}, acc -> if(acc.open is null, acc.out, array_append(acc.out, acc.open)))"
    return held.select(*line_keys, F.posexplode(F.expr(folded)).alias("box_no", "b")).select(*line_keys, "box_no", "b.*")


def prototype_index(prototypes: DataFrame) -> DataFrame:
    """codepoint, protos: the prototypes of each code point of a pack, in order."""
    return prototypes.groupBy("pack_id", "codepoint").agg(F.array_sort(F.collect_list("proto_no")).alias("protos"))


def with_fonts(fonts: list[DataFrame]) -> DataFrame:
    """The prototypes of several fonts, those of the first font first, without those that look like an earlier one."""
    every = None
    for k, rows in enumerate(fonts):
        rows = rows.withColumn("font_no", F.lit(k))
        every = rows if every is None else every.unionByName(rows)
    by = Window.partitionBy("pack_id", "bitmap").orderBy("font_no", "proto_no")
    return every.withColumn("i", F.row_number().over(by)).where("i = 1").drop("i")


def or_whole_image(glyphs: DataFrame, images: DataFrame) -> DataFrame:
    """The glyphs' boxes, and for an image that has none one box of its whole size."""
    whole = images.join(glyphs.select("image_id").distinct(), "image_id", "left_anti").select("image_id", F.lit(0).alias("glyph_no"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return glyphs.select("image_id", "glyph_no", "x", "y", "w", "h").unionByName(whole)


def image_sums(images: DataFrame) -> DataFrame:
    """image_id, width, height, total, weighted: sums over the pixels, plain and by place, that tell images apart."""
    rows = images.select("image_id", "width", "height", F.posexplode(F.split(F.decode("pixels", "ISO-8859-1"), "")).alias("i", "c"))
    v = F.ascii("c")
    return rows.groupBy("image_id", "width", "height").agg(F.sum(v).cast("long").alias("total"), F.sum(v * (F.col("i") % 251 + 1)).cast("long").alias("weighted"))
