"""Queries over grey samples, pages of several lines, glyph shapes, boxes and files, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import font, registry
from scriptorium.operators import detect, matching as M, ocr, text as T
from scriptorium.plans.images import _CAPITALS, _DETECTED, _INK, _ITEMS, ORACLES, QUERIES, _capitals, _detected, _items, _pages
from scriptorium.plans.texts import MIXED, PERCENT, RANKED, counts_sql, mixed, query, table, values
from scriptorium.sources import files, images, packs

__all__ = ["ORACLES", "QUERIES"]

# Texts as grey samples, 16 to a row: vowels and blanks are white, letters beyond U+00FF question marks.
_RASTER = """ras_t AS (SELECT item_id AS image_id, translate(regexp_replace(text, '[^\\x{0}-\\x{FF}]', '?', 'g'), 'aeiou ', 'ÿÿÿÿÿÿ') AS s FROM benchmark),
ras AS MATERIALIZED (SELECT image_id, CAST(len(s) // 16 AS INTEGER) AS h, CAST((i - 1) // 16 AS INTEGER) AS y, CAST((i - 1) % 16 AS INTEGER) AS x, unicode(s[i]) AS v FROM (SELECT image_id, s, unnest(range(1, 16 * (len(s) // 16) + 1)) AS i FROM ras_t))"""


def _sums(rows: str, width: str = "16", height: str = "h") -> str:
    return f"SELECT image_id, CAST({width} AS INTEGER) AS width, CAST({height} AS INTEGER) AS height, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * ((y * {width} + x) % 251 + 1)) AS BIGINT) AS weighted FROM {rows} GROUP BY ALL"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, d: the samples."""
    said = F.translate(F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?"), "aeiou ", "ÿ" * 6)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"), F.encode(said, "ISO-8859-1").alias("d")).withColumn("h", F.floor(F.octet_length("d") / 16).cast("int"))
    return rows.select("image_id", F.lit(16).alias("w"), "h", F.substring("d", F.lit(1), F.col("h") * 16).alias("d"))


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.from_samples(_samples(spark, sf_dir), id_col="image_id", width="w", height="h", channels=1, data="d")


@query(f"WITH {_RASTER} {_sums('ras')}")
def grey_samples(spark, sf_dir):
    return M.image_sums(_raster(spark, sf_dir))


_LUMINANCE = "CAST(trunc(CAST(0.299 AS FLOAT) * CAST({r} AS FLOAT) + CAST(0.587 AS FLOAT) * CAST({g} AS FLOAT) + CAST(0.114 AS FLOAT) * CAST({b} AS FLOAT)) AS INTEGER)"


@query(f"""WITH {_RASTER}, c AS (SELECT image_id, (h * 16) // 12 AS n, y * 16 + x AS i, v FROM ras),
p AS (SELECT image_id, n, i // 3 AS i, max(v) FILTER (WHERE i % 3 = 0) AS r, max(v) FILTER (WHERE i % 3 = 1) AS g, max(v) FILTER (WHERE i % 3 = 2) AS b FROM c WHERE i < n * 12 GROUP BY image_id, n, i // 3),
l AS (SELECT image_id, n AS h, i // 4 AS y, i % 4 AS x, {_LUMINANCE.format(r="r", g="g", b="b")} AS v FROM p) {_sums("l", "4")}""")
def luminance_of_samples(spark, sf_dir):
    """The samples taken for rows of four RGB pixels."""
    rows = _samples(spark, sf_dir).withColumn("w", F.lit(4)).withColumn("h", F.floor(F.octet_length("d") / 12).cast("int"))
    return M.image_sums(images.from_samples(rows, id_col="image_id", width="w", height="h", channels=3, data="d"))


_BAD = "CASE item_id % 4 WHEN 0 THEN 0 WHEN 1 THEN -4 WHEN 2 THEN -4 ELSE -2 END"


@query(f"SELECT item_id AS image_id, CAST({_BAD} AS INTEGER) AS code, CASE item_id % 4 WHEN 0 THEN 'X' ELSE '' END AS ocr_text FROM benchmark")
def result_codes(spark, sf_dir):
    """Images that are whole, without samples, without a size, and of a script that there is no pack for."""
    kind = F.col("item_id") % 4
    drawn = font.drawn("X")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"), F.when(kind == 2, 0).otherwise(drawn.shape[1]).alias("w"), F.lit(drawn.shape[0]).alias("h"), F.when(kind != 1, F.lit(bytearray(drawn.tobytes()))).alias("d"), F.when(kind == 3, "thai").alias("pack_hint"))
    grey = images.from_samples(rows, id_col="image_id", width="w", height="h", channels=1, data="d")
    return ocr.read_text(grey.join(rows.select("image_id", "pack_hint"), "image_id"), [ocr.latin_pack()]).select("image_id", "code", "ocr_text")


def _blur(rows: str, name: str) -> str:
    line = lambda by, over: f"(coalesce(lag(v) OVER (PARTITION BY image_id, {by} ORDER BY {over}), v) + 2 * v + coalesce(lead(v) OVER (PARTITION BY image_id, {by} ORDER BY {over}), v)) // 4"
    return f"{name}_x AS (SELECT image_id, h, y, x, {line('y', 'x')} AS v FROM {rows}), {name} AS MATERIALIZED (SELECT image_id, h, y, x, {line('x', 'y')} AS v FROM {name}_x)"


def _otsu(rows: str, name: str) -> str:
    return f"""{name}_h AS (SELECT image_id, v, count(*) AS n FROM {rows} GROUP BY image_id, v),
{name}_c AS (SELECT image_id, v, CAST(sum(n) OVER o AS DOUBLE) AS below, CAST(sum(n) OVER w AS DOUBLE) AS total, CAST(sum(n * v) OVER o AS DOUBLE) AS mass, CAST(sum(n * v) OVER w AS DOUBLE) AS whole FROM {name}_h WINDOW o AS (PARTITION BY image_id ORDER BY v), w AS (PARTITION BY image_id)),
{name}_b AS (SELECT image_id, v, CASE WHEN total > below THEN below * (total - below) * (mass / below - (whole - mass) / (total - below)) * (mass / below - (whole - mass) / (total - below)) ELSE 0 END AS between_ FROM {name}_c),
{name} AS (SELECT image_id, CASE WHEN max(between_) > 0 THEN (array_agg(v ORDER BY between_ DESC, v))[1] ELSE 128 END AS threshold FROM {name}_b GROUP BY image_id)"""


def _sauvola(rows: str, name: str) -> str:
    return f"""{name}_s AS (SELECT p.image_id, p.h, p.y, p.x, p.v, CAST(sum(q.v) AS DOUBLE) / 225 AS m, CAST(sum(q.v * q.v) AS DOUBLE) / 225 AS s FROM {rows} p, (SELECT unnest(range(-7, 8)) AS dy), (SELECT unnest(range(-7, 8)) AS dx)
JOIN {rows} q ON q.image_id = p.image_id AND q.y = greatest(0, least(p.h - 1, p.y + dy)) AND q.x = greatest(0, least(15, p.x + dx)) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT image_id, h, y, x, v >= trunc(greatest(0, least(255, m * (1 + 0.5::DOUBLE * (sqrt(greatest(s - m * m, 0)) / 128 - 1))))) AS bright FROM {name}_s)"""


@query(f"WITH {_RASTER}, {_blur('ras', 'b')} {_sums('b')}")
def blurred_samples(spark, sf_dir):
    return M.image_sums(ocr.processed(_raster(spark, sf_dir), "blurred"))


@query(f"WITH {_RASTER}, {_otsu('ras', 'o')} SELECT image_id, CAST(threshold AS INTEGER) AS threshold FROM o")
def otsu_threshold(spark, sf_dir):
    return M.otsu(M.histogram(M.pixel_rows(_raster(spark, sf_dir))))


@query(f"WITH {_RASTER}, {_sauvola('ras', 's')}, l AS (SELECT image_id, h, y, x, CASE WHEN bright THEN 255 ELSE 0 END AS v FROM s) {_sums('l')}")
def local_threshold(spark, sf_dir):
    return M.image_sums(ocr.processed(_raster(spark, sf_dir), "sauvola"))


_INKED = f"""{_blur('ras', 'bl')}, near AS (SELECT image_id, avg(CASE WHEN v < 20 OR v > 235 THEN 1.0 ELSE 0.0 END) > 0.92 AS plain FROM ras GROUP BY image_id),
base AS MATERIALIZED (SELECT r.image_id, r.h, r.y, r.x, CASE WHEN plain THEN r.v ELSE b.v END AS v FROM ras r JOIN bl b USING (image_id, y, x) JOIN near USING (image_id)), {_otsu('base', 'ot')}, {_sauvola('base', 'sv')},
first AS (SELECT image_id, h, y, x, v > threshold AS bright FROM base JOIN ot USING (image_id)), share AS (SELECT image_id, avg(CASE WHEN bright THEN 1::DOUBLE ELSE 0 END) BETWEEN 0.001 AND 0.5 AS ok FROM first GROUP BY image_id),
chosen AS (SELECT f.image_id, f.h, f.y, f.x, CASE WHEN ok THEN f.bright ELSE s.bright END AS bright FROM first f JOIN sv s USING (image_id, y, x) JOIN share USING (image_id)),
rare AS (SELECT image_id, avg(CASE WHEN bright THEN 1::DOUBLE ELSE 0 END) * 255 > 127 AS turn FROM chosen GROUP BY image_id),
inked AS (SELECT image_id, h, y, x, CASE WHEN bright <> turn THEN 255 ELSE 0 END AS v FROM chosen JOIN rare USING (image_id))"""


@query(f"WITH {_RASTER}, {_INKED} {_sums('inked')}")
def binarised_samples(spark, sf_dir):
    """Blur, Otsu's threshold, the local one where that fails, and the rarer colour as ink."""
    return M.image_sums(ocr.processed(_raster(spark, sf_dir), "binarised"))


def _turned(rows: str, angle: str) -> str:
    """Rows turned by an angle (a column of rows), nearest pixel, white outside."""
    c, s, half = f"CAST(cos({angle}) AS FLOAT)", f"CAST(sin({angle}) AS FLOAT)", "CAST(0.5 AS FLOAT)"
    px, py, cx, cy = "CAST(x AS FLOAT)", "CAST(y AS FLOAT)", "CAST(7.5 AS FLOAT)", "CAST((h - 1) / 2 AS FLOAT)"
    near = lambda v: f"CAST(sign({v}) * floor(abs({v}) + {half}) AS INTEGER)"
    ix, iy = near(f"({c} * ({px} - {cx}) + {s} * ({py} - {cy}) + {cx})"), near(f"(-{s} * ({px} - {cx}) + {c} * ({py} - {cy}) + {cy})")
    return f"SELECT t.image_id, t.h, t.y, t.x, coalesce(r.v, 255) AS v FROM (SELECT image_id, h, y, x, {ix} AS ix, {iy} AS iy FROM {rows}) t LEFT JOIN ras r ON r.image_id = t.image_id AND r.y = iy AND r.x = ix"


@query(f"WITH {_RASTER}, l AS ({_turned('ras', '0.3::DOUBLE')}) {_sums('l')}")
def rotated_samples(spark, sf_dir):
    return M.image_sums(ocr.processed(_raster(spark, sf_dir), "rotated", radians=0.3))


@query(f"""WITH {_RASTER}, dark AS (SELECT image_id, h, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM ras WHERE v < 200),
mean AS (SELECT image_id, h, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM dark GROUP BY ALL),
mom AS (SELECT image_id, max(n) AS n, sum((x - mx) * (y - my)) AS c, sum((x - mx) * (x - mx)) - sum((y - my) * (y - my)) AS d FROM dark JOIN mean USING (image_id) GROUP BY image_id),
ang AS (SELECT image_id, CASE WHEN n < 32 OR (abs(c) < 1e-6 AND abs(d) < 1e-6) THEN 0 ELSE greatest(-radians(15), least(radians(15), 0.5::DOUBLE * atan2(2 * c, d))) END AS a FROM mom),
every AS (SELECT r.*, CASE WHEN h < 8 OR a IS NULL OR abs(a) < 0.02 THEN 0::DOUBLE ELSE -a END AS a FROM ras r LEFT JOIN ang USING (image_id)),
l AS ({_turned('every', 'a')}) {_sums('l')}""")
def deskewed_samples(spark, sf_dir):
    return M.image_sums(ocr.processed(_raster(spark, sf_dir), "deskewed"))


@query(f"""WITH RECURSIVE {_RASTER}, ink AS MATERIALIZED (SELECT image_id, y, x FROM ras WHERE v < 105),
reach AS (SELECT image_id, y AS y0, x AS x0, y, x FROM ink UNION SELECT r.image_id, y0, x0, i.y, i.x FROM reach r JOIN ink i ON i.image_id = r.image_id AND ((i.y = r.y AND i.x IN (r.x - 1, r.x + 1)) OR (i.x = r.x AND i.y IN (r.y - 1, r.y + 1)))),
lab AS (SELECT image_id, y0, x0, min(y * 16 + x) AS label FROM reach GROUP BY ALL)
SELECT image_id, CAST(min(x0) AS INTEGER) AS x, CAST(min(y0) AS INTEGER) AS y, CAST(max(x0) - min(x0) + 1 AS INTEGER) AS w, CAST(max(y0) - min(y0) + 1 AS INTEGER) AS h, CAST(count(*) AS INTEGER) AS n FROM lab GROUP BY image_id, label""")
def connected_parts(spark, sf_dir):
    return ocr.read_parts(_raster(spark, sf_dir), 105)


# Files.


def _folder(spark: SparkSession) -> str:
    return f"{files.scratch(spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {_RASTER} {_sums('ras')}")
def pnm_round_trip(spark, sf_dir):
    """The samples as P5 files in a column, and read from there."""
    return M.image_sums(images.from_pnm(images.with_pgm(_raster(spark, sf_dir)), "image_id", "content"))


@query(f"""WITH {_RASTER}, l AS (SELECT image_id, h, y, x, CASE WHEN image_id % 2 = 0 THEN v ELSE {_LUMINANCE.format(r="v", g="v", b="v")} END AS v FROM ras WHERE image_id % 7 <> 3),
s AS ({_sums("l")}) SELECT item_id AS image_id, width, height, total, weighted, CAST(CASE WHEN item_id % 7 = 3 THEN -1 ELSE 0 END AS INTEGER) AS code FROM benchmark LEFT JOIN s ON image_id = item_id""")
def image_files(spark, sf_dir):
    """The samples as PNG and BMP files, of which some are damaged, read as a folder by Spark's image source."""
    rows, folder, even = _raster(spark, sf_dir), _folder(spark), F.col("image_id") % 2 == 0
    both = images.with_file(rows.where(even), "png").unionByName(images.with_file(rows.where(~even), "bmp"))
    named = both.select(F.concat(F.col("image_id").cast("string"), F.when(even, ".png").otherwise(".bmp")).alias("name"), F.when(F.col("image_id") % 7 == 3, F.substring("content", 1, 20)).otherwise(F.col("content")).alias("content"))
    files.save(named, folder, "name", "content")
    read = images.read_images(spark, folder).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))
    return read.select("image_id", "code").join(M.image_sums(read.where("error is null")), "image_id", "left")


@query("""WITH c AS (SELECT item_id, unnest(string_split(translate(text, '.', chr(10)), chr(10))) AS l, unnest(range(1, 10000)) AS i FROM benchmark), k AS (SELECT 'l' || (item_id % 5) AS lang, trim(l) AS text, row_number() OVER (PARTITION BY item_id % 5 ORDER BY item_id, i) AS line_no FROM c WHERE regexp_matches(l, '\\S'))
SELECT lang, CAST(line_no AS INTEGER) AS line_no, text FROM k""")
def corpora(spark, sf_dir):
    """Corpus files of several languages, a sentence a line, written and read."""
    items, folder = table(spark, sf_dir, "benchmark"), _folder(spark)
    lines = F.translate("text", ".", "\n")
    rows = items.groupBy((F.col("item_id") % 5).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", lines.alias("t")))), lambda x: x["t"]), "\n\n \n").alias("content"))
    files.save(rows.select(F.format_string("l%d/corpus.txt", "k").alias("name"), "content"), folder, "name", "content")
    return images.read_corpora(spark, folder)


# Shapes.  The font's cells as 35 signs row by row, so that SQL can work on them.
_CELLS = values([(chr(32 + k), "".join(str(int(b)) for b in cell.ravel())) for k, cell in enumerate(font.CELLS) if cell.any()], "cells(ch, bits)")
_BESIDE = "+".join(f"l[j{d:+d}]" for d in (-23, -22, -21, -1, 1, 21, 22, 23))
_INSIDE = "(j - 1) // 22 BETWEEN 2 AND 27 AND (j - 1) % 22 BETWEEN 2 AND 19"


def _pass(column: str, test: str) -> str:
    """A shape on the framed grid of 22 by 30 without the pixels inside whose count of neighbours passes a test."""
    return f"list_transform(range(1, 661), lambda j: CASE WHEN {column}[j] = 1 AND {_INSIDE} AND ({_BESIDE.replace('l[', f'{column}[')}) {test} THEN 0 ELSE {column}[j] END)"


_SHAPES = f"""grid AS (SELECT ch, bits, list_transform(range(1, 661), lambda j: CASE WHEN (j - 1) // 22 BETWEEN 1 AND 28 AND (j - 1) % 22 BETWEEN 1 AND 20 THEN CAST(bits[(((j - 1) // 22 - 1) // 4) * 5 + ((j - 1) % 22 - 1) // 4 + 1] AS INTEGER) ELSE 0 END) AS l FROM {_CELLS}),
thin AS (SELECT ch, 0 AS k, l, true AS live FROM grid UNION ALL SELECT ch, k + 1, b, b <> l FROM (SELECT ch, k, l, {_pass("a", "= 4")} AS b FROM (SELECT ch, k, l, {_pass("l", "< 2")} AS a FROM thin WHERE live AND k < 32))),
last AS (SELECT ch, arg_max(l, k) AS l FROM thin GROUP BY ch),
tips AS (SELECT ch, least(255, len(list_filter(range(1, 661), lambda j: l[j] = 1 AND ({_BESIDE}) <= 1))) AS ends, least(255, len(list_filter(range(1, 661), lambda j: l[j] = 1 AND ({_BESIDE}) >= 3))) AS forks FROM last),
frame AS (SELECT ch, list_transform(range(1, 64), lambda j: CASE WHEN (j - 1) // 7 BETWEEN 1 AND 7 AND (j - 1) % 7 BETWEEN 1 AND 5 AND bits[((j - 1) // 7 - 1) * 5 + (j - 1) % 7] = '1' THEN 0 ELSE j END) AS l FROM {_CELLS}),
flood AS (SELECT ch, 0 AS k, l FROM frame UNION ALL SELECT ch, k + 1, list_transform(range(1, 64), lambda j: CASE WHEN l[j] = 0 THEN 0 ELSE least(l[j], CASE WHEN (j - 1) % 7 > 0 AND l[j - 1] > 0 THEN l[j - 1] ELSE 99 END, CASE WHEN (j - 1) % 7 < 6 AND l[j + 1] > 0 THEN l[j + 1] ELSE 99 END, CASE WHEN j > 7 AND l[j - 7] > 0 THEN l[j - 7] ELSE 99 END, CASE WHEN j < 57 AND l[j + 7] > 0 THEN l[j + 7] ELSE 99 END) END) FROM flood WHERE k < 40),
gaps AS (SELECT ch, len(list_distinct(list_filter(l, lambda v: v > 0))) - 1 AS holes FROM flood WHERE k = 40),
dot AS (SELECT ch, (i - 1) // 5 AS y, (i - 1) % 5 AS x FROM (SELECT ch, bits, unnest(range(1, 36)) AS i FROM {_CELLS}) WHERE bits[i] = '1'),
wide AS (SELECT ch, CAST(CAST(4 * (max(x) - min(x) + 1) AS FLOAT) / CAST(4 * (max(y) - min(y) + 1) AS FLOAT) AS DOUBLE) AS aspect, 16 * count(*) AS cells FROM dot GROUP BY ch),
shape AS MATERIALIZED (SELECT ch, bits, holes, ends, forks, aspect, cells FROM {_CELLS} JOIN tips USING (ch) JOIN gaps USING (ch) JOIN wide USING (ch))"""


@query(f"""WITH RECURSIVE {_SHAPES}, said AS (SELECT c AS ch, count(*) AS times FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) GROUP BY c)
SELECT ch, times, CAST(holes AS INTEGER) AS holes, CAST(ends AS INTEGER) AS endpoints, CAST(forks AS INTEGER) AS junctions, aspect FROM said JOIN shape USING (ch)""")
def glyph_features(spark, sf_dir):
    """Holes, ends, forks and aspect of the characters that texts have, drawn on the Latin pack's grid."""
    said = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("times"))
    shapes = ocr.prototype_table(spark, [ocr.latin_pack()]).select(T.character("codepoint").alias("ch"), "holes", "endpoints", "junctions", "aspect")
    return said.join(F.broadcast(shapes), "ch").select("ch", "times", "holes", "endpoints", "junctions", "aspect")


@query(f"""WITH RECURSIVE {_SHAPES}, hexed AS (SELECT ch, md5(array_to_string(list_transform(range(1, 561), lambda i: CASE WHEN bits[((i - 1) // 20 // 4) * 5 + (i - 1) % 20 // 4 + 1] = '1' THEN 'FF' ELSE '00' END), '')) AS bitmap_md5 FROM {_CELLS})
SELECT 'latin' AS pack_id, CAST(20 AS INTEGER) AS grid_w, CAST(28 AS INTEGER) AS grid_h, CAST(row_number() OVER (ORDER BY unicode(ch)) - 1 AS INTEGER) AS proto_no, CAST(unicode(ch) AS BIGINT) AS codepoint, CAST(holes AS INTEGER) AS holes, CAST(ends AS INTEGER) AS endpoints, CAST(forks AS INTEGER) AS junctions, round(aspect, 6) AS aspect, bitmap_md5 FROM shape JOIN hexed USING (ch)""")
def pack_prototypes(spark, sf_dir):
    """The Latin prototypes, written to a pack file from several tasks and read from there."""
    folder = _folder(spark)
    packs.register(spark)
    spark.createDataFrame(packs.rows_of(ocr.latin_pack()), packs.SCHEMA).repartition(4).write.format("glyphpack").mode("overwrite").save(folder)
    read = spark.read.format("glyphpack").option("ids", "latin").load(folder)
    return read.select("pack_id", "grid_w", "grid_h", "proto_no", "codepoint", "holes", "endpoints", "junctions", F.round(F.col("aspect").cast("double"), 6).alias("aspect"), F.md5(F.hex("bitmap").cast("binary")).alias("bitmap_md5"))


@query(f"""WITH t AS (SELECT item_id AS image_id, {_CAPITALS} AS s FROM benchmark), c AS (SELECT image_id, i, s[i] AS c FROM (SELECT image_id, s, unnest(range(1, len(s) + 1)) AS i FROM t))
SELECT image_id, CAST(0 AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS INTEGER) AS glyph_no, 'latin' AS pack_id, CAST(unicode(c) AS BIGINT) AS codepoint, CAST(1 AS DOUBLE) AS confidence FROM c WHERE c <> ' '""")
def match_drawn_letters(spark, sf_dir):
    """Glyphs cut from drawn pages against the prototypes, by the relational match."""
    latin = ocr.latin_pack()
    glyphs = ocr.cut_glyphs(_pages(spark, sf_dir), latin)
    found = M.match_prototypes(glyphs, ocr.prototype_table(spark, [latin]), M.packs(spark), ["image_id", "line_no", "glyph_no"])
    return found.withColumn("confidence", F.round("confidence", 9))


# Pages of several lines of 16 signs, alternately 5 and 24 rows apart: near lines are joined, and cut again on tall pages.
_GAPS = [24, 5]
_ON_LINES = f"""t AS (SELECT item_id AS image_id, {_CAPITALS} AS s FROM benchmark), size AS (SELECT image_id, (len(s) + 15) // 16 AS n FROM t),
page AS (SELECT image_id, CASE WHEN n = 0 THEN 32 ELSE 32 + 28 * n + 5 * (n // 2) + 24 * ((n - 1) // 2) END AS h FROM size),
cell AS (SELECT image_id, s[i] AS ch, (i - 1) // 16 AS line, (i - 1) % 16 AS col FROM (SELECT image_id, s, unnest(range(1, len(s) + 1)) AS i FROM t)),
px AS MATERIALIZED (SELECT image_id, 16 + 28 * line + 5 * ((line + 1) // 2) + 24 * (line // 2) + 4 * ((k - 1) // 5) + dy AS y, 16 + 28 * col + 4 * ((k - 1) % 5) + dx AS x
  FROM (SELECT image_id, line, col, bits, unnest(range(1, 36)) AS k FROM cell JOIN {_CELLS} USING (ch)), (SELECT unnest(range(4)) AS dy), (SELECT unnest(range(4)) AS dx) WHERE bits[k] = '1')"""


def _bands(name: str, ink: str, keys: str) -> str:
    """Bands of rows with enough ink within each group of ``keys``: y0, y1 and the extent x0, x1 of their ink."""
    return f"""{name}_r AS (SELECT {keys}, y, count(*) AS n FROM {ink} GROUP BY {keys}, y), {name}_m AS (SELECT {keys}, greatest(1, max(n) // 20) AS least_n FROM {name}_r GROUP BY {keys}),
{name}_k AS (SELECT {keys}, y, y - row_number() OVER (PARTITION BY {keys} ORDER BY y) AS isle FROM {name}_r JOIN {name}_m USING ({keys}) WHERE n >= least_n),
{name}_b AS (SELECT {keys}, isle, min(y) AS y0, max(y) + 1 AS y1 FROM {name}_k GROUP BY {keys}, isle HAVING max(y) + 1 - min(y) >= 4),
{name} AS MATERIALIZED (SELECT {keys}, y0, y1, min(i.x) AS x0, max(i.x) + 1 AS x1 FROM {name}_b JOIN {ink} i USING ({keys}) WHERE i.y >= y0 AND i.y < y1 GROUP BY {keys}, y0, y1 HAVING max(i.x) > min(i.x))"""


@query(f"""WITH {_ON_LINES}, {_bands("band", "px", "image_id")},
gap AS (SELECT b.*, p.h AS page_h, CASE WHEN b.y0 - lag(b.y1) OVER (PARTITION BY b.image_id ORDER BY b.y0) <= CASE WHEN p.h > 200 THEN 8 ELSE greatest(8, p.h // 12) END THEN 0 ELSE 1 END AS new FROM band b JOIN page p USING (image_id)),
grp AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY y0) AS g FROM gap),
box AS MATERIALIZED (SELECT image_id, g, page_h, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM grp GROUP BY image_id, g, page_h),
inside AS MATERIALIZED (SELECT b.image_id, b.g, p.y, p.x FROM box b JOIN px p ON p.image_id = b.image_id AND p.y >= by0 AND p.y < by1 AND p.x >= bx0 AND p.x < bx1 WHERE page_h > 200 AND by1 - by0 > greatest(48, page_h // 10)),
{_bands("sub", "inside", "image_id, g")},
line AS (SELECT image_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM sub UNION ALL SELECT image_id, bx0, by0, bx1 - bx0, by1 - by0 FROM box b WHERE NOT EXISTS (SELECT 1 FROM sub s WHERE s.image_id = b.image_id AND s.g = b.g))
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS INTEGER) AS line_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM line""")
def lines_of_pages(spark, sf_dir):
    return ocr.read_lines(_lined(spark, sf_dir))


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _capitals()
    lines = F.when(F.length(said) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(said) - 1) / 16).cast("int")), lambda i: F.substring(said, i * 16 + 1, F.lit(16)))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", lines.alias("lines")).repartition(2 * spark.sparkContext.defaultParallelism)
    return ocr.draw_lines(rows, "lines", _GAPS, id_col="item_id")


# Every word on a page of its own, cut by each segmenter: letters stand apart; joined scripts take a line of at most 250 pixels
# for one glyph.
@query(f"""WITH w AS (SELECT item_id * 100000 + i AS image_id, ws[i] AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, string_split({_CAPITALS}, ' ') AS ws FROM benchmark)) WHERE ws[i] <> ''),
c AS (SELECT image_id, i, s[i] AS c, s[1] = 'I' AS thin FROM (SELECT image_id, s, unnest(range(1, len(s) + 1)) AS i FROM w)),
g AS MATERIALIZED (SELECT image_id, i - 1 AS glyph_no, 28 * (i - 1) + CASE WHEN c = 'I' THEN 4 ELSE 0 END - CASE WHEN thin THEN 4 ELSE 0 END AS x, CASE WHEN c = 'I' THEN 12 ELSE 20 END AS w FROM c),
l AS (SELECT image_id, max(x + w) AS width FROM g GROUP BY image_id),
r AS (SELECT how, image_id, glyph_no, x, w FROM g, (VALUES ('plain'), ('indic'), ('marks')) h(how) UNION ALL SELECT 'arabic', image_id, glyph_no, x, w FROM g JOIN l USING (image_id) WHERE width > 250 UNION ALL SELECT 'arabic', image_id, 0, 0, width FROM l WHERE width <= 250)
SELECT how, image_id, CAST(glyph_no AS INTEGER) AS glyph_no, CAST(x AS INTEGER) AS x, CAST(w AS INTEGER) AS w FROM r""")
def segmented_words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(_capitals(), " ")).alias("i", "text")).where("text <> ''")
    pages = ocr.draw_terminal(words.select((F.col("item_id") * 100000 + F.col("i") + 1).alias("image_id"), "text").repartition(2 * spark.sparkContext.defaultParallelism))
    return ocr.segment_lines(pages, *ocr.SEGMENTERS).drop("line_no")


# Boxes of glyphs, eight to a line.
_BOXES = ("line_key AS line_id", "place AS glyph_no", "CAST(place * 14 + k1 % 17 AS INTEGER) AS x", "CAST(k2 % 9 AS INTEGER) AS y", "CAST(3 + k2 % 12 AS INTEGER) AS w", "CAST(2 + k1 % 23 AS INTEGER) AS h")


def _joins_sql(rule: str) -> str:
    test = M.JOINS[rule].replace(" div ", " // ").replace("gap", "(g.x - p.x - p.w)").replace("overlap", "(least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x))").replace("line_h", "g.line_h")
    either = lambda a, b: f"CASE WHEN {test} THEN {a} ELSE {b} END"
    return f"""{rule} AS (SELECT line_id, glyph_no, x, y, w, h, 0 AS box_no, 1 AS parts FROM b WHERE glyph_no = 0 UNION ALL
SELECT g.line_id, g.glyph_no, {either("least(p.x, g.x)", "g.x")}, {either("least(p.y, g.y)", "g.y")}, {either("greatest(p.x + p.w, g.x + g.w) - least(p.x, g.x)", "g.w")}, {either("greatest(p.y + p.h, g.y + g.h) - least(p.y, g.y)", "g.h")}, p.box_no + {either("0", "1")}, {either("p.parts + 1", "1")}
FROM {rule} p JOIN b g ON g.line_id = p.line_id AND g.glyph_no = p.glyph_no + 1)"""


@query(f"""WITH RECURSIVE {_ITEMS}, r AS (SELECT {', '.join(_BOXES)} FROM items), b AS MATERIALIZED (SELECT *, greatest(max(y + h) OVER (PARTITION BY line_id), max(h) OVER (PARTITION BY line_id)) AS line_h FROM r),
{', '.join(map(_joins_sql, M.JOINS))}, every AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, * FROM {r}" for r in M.JOINS)})
SELECT rule, line_id, CAST(box_no AS INTEGER) AS box_no, CAST(arg_max(x, glyph_no) AS INTEGER) AS x, CAST(arg_max(y, glyph_no) AS INTEGER) AS y, CAST(arg_max(w, glyph_no) AS INTEGER) AS w, CAST(arg_max(h, glyph_no) AS INTEGER) AS h, CAST(max(parts) AS INTEGER) AS parts FROM every GROUP BY rule, line_id, box_no""")
def merged_boxes(spark, sf_dir):
    """Marks with their letters, touching parts, and near parts, by each of the three rules."""
    boxes, out = _items(spark, sf_dir).selectExpr(*_BOXES), None
    for rule in M.JOINS:
        rows = M.merged_boxes(boxes, ["line_id"], rule).select(F.lit(rule).alias("rule"), "line_id", "box_no", "x", "y", "w", "h", "parts")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_ITEMS} SELECT line_id, glyph_no, w * 12 > 120 AND w * 12 > 2 * h AS oversized FROM (SELECT {', '.join(_BOXES)} FROM items)")
def oversized_boxes(spark, sf_dir):
    return _items(spark, sf_dir).selectExpr(*_BOXES).select("line_id", "glyph_no", M.oversized(F.col("w") * 12, F.col("h")).alias("oversized"))


_WHOLE = "SELECT line_key AS image_id, CAST(300 + line_key % 7 AS INTEGER) AS width, CAST(60 AS INTEGER) AS height FROM items GROUP BY line_key"


@query(f"""WITH {_ITEMS}, g AS (SELECT line_id AS image_id, CAST(glyph_no AS INTEGER) AS glyph_no, x, y, w, h FROM (SELECT {', '.join(_BOXES)} FROM items) WHERE line_id % 3 <> 0)
SELECT * FROM g UNION ALL SELECT image_id, 0, 0, 0, width, height FROM ({_WHOLE}) WHERE image_id % 3 = 0""")
def whole_image_boxes(spark, sf_dir):
    """Images without a glyph count as one glyph."""
    rows = _items(spark, sf_dir)
    glyphs = rows.selectExpr(*_BOXES).where("line_id % 3 <> 0").withColumn("glyph_no", F.col("glyph_no").cast("int")).withColumnRenamed("line_id", "image_id")
    sizes = rows.groupBy(F.col("line_key").alias("image_id")).agg(F.lit(60).alias("height")).withColumn("width", (300 + F.col("image_id") % 7).cast("int"))
    return M.or_whole_image(glyphs, sizes)


_PARTS = "SELECT p_brand AS pack_id, CAST(p_size % 12 AS INTEGER) AS codepoint, p_size AS bitmap, p_partkey AS proto_no FROM part"


@query(f"SELECT pack_id, codepoint, string_agg(proto_no, ',' ORDER BY proto_no) AS protos, count(*) AS n FROM ({_PARTS}) GROUP BY pack_id, codepoint")
def prototype_index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as pack_id", "cast(p_size % 12 as int) as codepoint", "p_partkey as proto_no")
    return M.prototype_index(rows).select("pack_id", "codepoint", F.array_join("protos", ",").alias("protos"), F.size("protos").cast("long").alias("n"))


@query(f"SELECT pack_id, bitmap, codepoint, proto_no, CAST(font_no AS INTEGER) AS font_no FROM (SELECT *, row_number() OVER (PARTITION BY pack_id, bitmap ORDER BY font_no, proto_no) AS i FROM (SELECT *, (proto_no + 1) % 2 AS font_no FROM ({_PARTS}))) WHERE i = 1")
def prototypes_of_fonts(spark, sf_dir):
    """Prototypes of two fonts, without those that look like an earlier one."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as pack_id", "cast(p_size % 12 as int) as codepoint", "p_size as bitmap", "p_partkey as proto_no")
    return M.with_fonts([rows.where("proto_no % 2 = 1"), rows.where("proto_no % 2 = 0")]).select("pack_id", "bitmap", "codepoint", "proto_no", "font_no")


# Where results come from.


@query(f"""WITH {_DETECTED} SELECT image_id, CASE WHEN read = '' AND image_id % 3 = 2 THEN hint ELSE read END AS text, CASE WHEN read = '' AND image_id % 3 = 2 AND hint <> '' THEN 'unicode' ELSE 'ocr' END AS identification_source, read = '' AND image_id % 3 = 2 AND hint <> '' AS fallback_used FROM d""")
def detection_in_memory(spark, sf_dir):
    """Samples in memory: never hybrid, and the hint doesn't choose the pack."""
    return _detected(spark, sf_dir, route_by_hint=False, hybrid=False).select("image_id", "text", "identification_source", "fallback_used")


_SYNTHETIC = f"SELECT item_id, {_CAPITALS} AS said, item_id % 4 AS k FROM benchmark"


@query(f"""SELECT item_id AS image_id, CASE k WHEN 0 THEN replace(replace(said, 'II', 'I I'), 'II', 'I I') WHEN 1 THEN said WHEN 2 THEN '漢字' ELSE '' END AS text, CASE k WHEN 0 THEN replace(replace(said, 'II', 'I I'), 'II', 'I I') WHEN 2 THEN replace(replace(said, 'II', 'I I'), 'II', 'I I') ELSE '' END AS ocr_text,
CASE WHEN k = 2 THEN 'unicode' ELSE 'ocr' END AS identification_source, k = 2 OR k = 1 AND said <> '' AS fallback_used FROM ({_SYNTHETIC})""")
def detection_of_drawn(spark, sf_dir):
    """Images drawn from a known text: whole, blank, of a script without a pack, and without a letter."""
    said, k = _capitals(), F.col("item_id") % 4
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"), F.when(k.isin(0, 2), said).otherwise("").alias("text"), F.when(k == 2, "漢字").when(k == 3, "12 !").otherwise(said).alias("hint"))
    drawn = ocr.draw_terminal(rows.select("image_id", "text").repartition(2 * spark.sparkContext.defaultParallelism))
    found = detect.detect_drawn(drawn.join(rows.select("image_id", "hint"), "image_id"), [ocr.latin_pack()], "hint")
    return found.select("image_id", "text", "ocr_text", "identification_source", "fallback_used")


@query(f"""WITH {MIXED}, chosen AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'жжж' || chr(10) || text WHEN 1 THEN text WHEN 2 THEN '' ELSE 'αβγ' END AS text FROM mixed), {counts_sql('chosen', 'doc_id')}, {PERCENT}, {RANKED}
SELECT doc_id, string_agg(code || ':' || percent, ',' ORDER BY rank) AS languages FROM ranks GROUP BY doc_id""")
def languages_of_lines(spark, sf_dir):
    """Lines override the text unless there are none; blank lines leave nothing."""
    k = F.col("doc_id") % 4
    lines = F.when(k == 0, F.array(F.lit("жжж"), F.lit("  "), F.col("text"))).when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit(" "))).otherwise(F.array(F.lit("αβγ")))
    found = T.detect_lines(mixed(spark, sf_dir).withColumn("lines", lines), "lines")
    return found.where(F.size("languages") > 0).select("doc_id", F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["code"], x["percent"].cast("string"))), ",").alias("languages"))


@query(f"SELECT format('{{:<4}}  {{:<11}}  {{:<29}}  yes', code, name, script) AS line FROM {values([(x[0], x[1], x[2]) for x in registry.LANGUAGES], 'g(code, name, script)')}")
def registry_table(spark, sf_dir):
    """The registry as lines of a table."""
    return registry.languages(spark).select(F.format_string("%-4s  %-11s  %-29s  yes", "code", "name", "script").alias("line"))


@query()
def ascii_error_report(spark, sf_dir):
    """Whole texts in printable ASCII, drawn and recognised: the error rate on what was recognised, capitals or not."""
    said = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\x20-\x7E]", ""), " +", " "))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"), said.alias("text"))
    read = ocr.read_text(ocr.draw_terminal(rows.repartition(2 * spark.sparkContext.defaultParallelism)), [ocr.latin_pack()])
    return T.error_rate(read.join(rows, "image_id").withColumn("kind", F.lit("ascii")), ["kind"], "text", "ocr_text")


@query()
def script_error_report(spark, sf_dir):
    """The letters of scripts that an installed font has, drawn one by one by the driver's JVM and recognised among all those
    packs: strings, errors and the budget by language."""
    from scriptorium.jobs import error_rates

    table(spark, sf_dir, "benchmark")
    return error_rates.letters(spark, ["ru", "el", "he", "hy", "ka", "ar"]).select("lang", "strings", "errors", "chars", "cer", "max_cer", "passed")
