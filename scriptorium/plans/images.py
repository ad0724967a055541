"""Queries over drawn pages and over tables of glyphs and scores, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import font, registry
from scriptorium.operators import detect, matching as M, ocr, text as T
from scriptorium.plans.texts import ORACLES, QUERIES, query, table, values

__all__ = ["ORACLES", "QUERIES"]

PACKS = values([(i, *p[:9], int(p[9])) for i, p in enumerate(registry.PACKS)], "pk(seq, pack_id, grid_w, grid_h, threshold, w_ncc, w_struct, w_aspect, cal_a, cal_b, rtl)")

# What the terminal font can say without doubt: capitals and single blanks.  Two thin letters in a row stand so far apart that
# a blank is seen between them.
_CAPITALS = "trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', '')), '[^A-Z ]', '', 'g'), ' +', ' ', 'g'))"


def _capitals():
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.replace("text", F.lit("ß"), F.lit(""))), "[^A-Z ]", ""), " +", " "))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    said = _capitals()
    spread = items.select("item_id", said.alias("text")).repartition(2 * spark.sparkContext.defaultParallelism)  # small rows, large pages
    return ocr.draw_terminal(spread, id_col="item_id")


@query(f"SELECT item_id AS image_id, replace(replace({_CAPITALS}, 'II', 'I I'), 'II', 'I I') AS ocr_text, CAST(len(replace({_CAPITALS}, ' ', '')) AS INTEGER) AS glyph_count, CAST(1.0 AS DOUBLE) AS mean_confidence FROM benchmark")
def ocr_roundtrip(spark, sf_dir):
    return ocr.read_text(_pages(spark, sf_dir), [ocr.latin_pack()]).select("image_id", "ocr_text", "glyph_count", "mean_confidence")


@query(f"""WITH t AS (SELECT item_id AS image_id, {_CAPITALS} AS s FROM benchmark), c AS (SELECT image_id, i, s[i] AS c FROM (SELECT image_id, s, unnest(range(1, len(s) + 1)) AS i FROM t))
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS INTEGER) AS glyph_no, CAST(28 * (i - 1) + CASE WHEN c = 'I' THEN 4 ELSE 0 END - first AS INTEGER) AS x,
CAST(CASE WHEN c = 'I' THEN 12 ELSE 20 END AS INTEGER) AS w, CAST(28 AS INTEGER) AS h, unicode(c) AS codepoint, 'latin' AS pack_id
FROM c JOIN (SELECT image_id, CASE WHEN s[1] = 'I' THEN 4 ELSE 0 END AS first FROM t) USING (image_id) WHERE c <> ' '""")
def glyph_diagnostics(spark, sf_dir):
    return ocr.read_glyphs(_pages(spark, sf_dir), [ocr.latin_pack()]).select("image_id", "glyph_no", "x", "w", "h", "codepoint", "pack_id")


@query(f"SELECT item_id AS image_id, CAST(32 + 28 * len({_CAPITALS}) AS INTEGER) AS width, CAST(60 AS INTEGER) AS height, CAST(60 * (32 + 28 * len({_CAPITALS})) AS BIGINT) AS n_pixels FROM benchmark")
def terminal_images(spark, sf_dir):
    return _pages(spark, sf_dir).select("image_id", "width", "height", F.length("pixels").cast("long").alias("n_pixels"))


# The font as a table of dots, so that SQL can draw the pages, too.
_DOTS = values([(chr(32 + k), r, c) for k in range(33, 59) for r in range(7) for c in range(5) if font.CELLS[k][r][c]], "dots(ch, r, c)")
_INK = f"""t AS (SELECT item_id AS image_id, {_CAPITALS} AS s FROM benchmark),
dots_on AS (SELECT image_id, 16 + 4 * r + dy AS y, 16 + 28 * (i - 1) + 4 * c + dx AS x FROM (SELECT image_id, s[i] AS ch, i FROM (SELECT image_id, s, unnest(range(1, len(s) + 1)) AS i FROM t)) JOIN {_DOTS} USING (ch), (SELECT unnest(range(4)) AS dy), (SELECT unnest(range(4)) AS dx))"""


@query(f"""WITH {_INK}, n AS (SELECT image_id, count(*) AS n FROM dots_on GROUP BY image_id)
SELECT image_id, CAST(0 AS INTEGER) AS v, n FROM n UNION ALL SELECT item_id, CAST(255 AS INTEGER), 60 * (32 + 28 * len({_CAPITALS})) - n FROM benchmark JOIN n ON item_id = image_id""")
def pixel_histogram(spark, sf_dir):
    return M.histogram(M.pixel_rows(_pages(spark, sf_dir)))


@query(f"WITH {_INK} SELECT image_id, CAST(yy AS INTEGER) AS y, count(d.y) AS ink FROM (SELECT item_id AS image_id, unnest(range(60)) AS yy FROM benchmark) p LEFT JOIN (SELECT image_id AS i, y FROM dots_on) d ON d.i = p.image_id AND d.y = p.yy GROUP BY image_id, yy")
def row_projection(spark, sf_dir):
    return M.ink_by_row(M.pixel_rows(_pages(spark, sf_dir)), F.col("v") < 128)


@query("SELECT item_id AS image_id, 16 AS y0, 44 AS y1 FROM benchmark")
def line_bands(spark, sf_dir):
    return M.bands(M.ink_by_row(M.pixel_rows(_pages(spark, sf_dir)), F.col("v") < 128))


@query(f"""WITH {_INK}, cols AS (SELECT DISTINCT image_id, x FROM dots_on), g AS (SELECT image_id, x, x - row_number() OVER (PARTITION BY image_id ORDER BY x) AS k FROM cols)
SELECT image_id, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) + 1 AS INTEGER) AS x1 FROM g GROUP BY image_id, k""")
def glyph_segments(spark, sf_dir):
    """Runs of columns with ink: gaps and islands over the pixels."""
    columns = M.pixel_rows(_pages(spark, sf_dir)).groupBy("image_id", F.col("x").alias("y")).agg(F.count_if(F.col("v") < 128).alias("ink"))
    return M.bands(columns.withColumn("ink", F.when(F.col("ink") > 0, 20).otherwise(0)), 2).select("image_id", F.col("y0").alias("x0"), F.col("y1").alias("x1"))


# Tables of scores stand in as numbers made from events: eight events in a row are a line of text, each a glyph of it.
_ITEMS = "items AS (SELECT event_id // 8 AS line_key, event_id % 8 AS place, (user_id * 7919 + event_id * 31) % 2003 AS k1, (user_id * 104729 + event_id * 17) % 101 AS k2, CAST(1 + event_id % 50 AS DOUBLE) AS size, CAST(event_id % 9 AS DOUBLE) / 100 AS tilt, CAST(user_id % 11 AS DOUBLE) / 100 AS sure FROM events)"


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id div 8 as line_key", "event_id % 8 as place", "(user_id * 7919 + event_id * 31) % 2003 as k1", "(user_id * 104729 + event_id * 17) % 101 as k2", "cast(1 + event_id % 50 as double) as size", "cast(event_id % 9 as double) / 100 as tilt", "cast(user_id % 11 as double) / 100 as sure")


_SCORES = f"""{_ITEMS}, scores AS (SELECT line_key AS line_id, place AS glyph_no, pack_id, seq, (k1 * 31 + seq * 17 + place * 7) % 97 AS num FROM items, {PACKS})"""


def _scores(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir).select(F.col("line_key").alias("line_id"), F.col("place").alias("glyph_no"), "k1")
    joined = items.join(F.broadcast(M.packs(spark).select("pack_id", "seq")))
    return joined.withColumn("confidence", ((F.col("k1") * 31 + F.col("seq") * 17 + F.col("glyph_no") * 7) % 97).cast("double")).drop("k1")


@query(f"""WITH {_SCORES}, f AS (SELECT *, dense_rank() OVER (PARTITION BY line_id ORDER BY glyph_no) AS k FROM scores), m AS (SELECT line_id, pack_id, seq, avg(num * num) / 20000 AS mean FROM f WHERE k <= 5 GROUP BY ALL),
b AS (SELECT line_id, max(mean) FILTER (WHERE pack_id = 'latin') AS l, arg_max(pack_id, mean * 1000000000 - seq) FILTER (WHERE pack_id <> 'latin') AS o, max(mean) FILTER (WHERE pack_id <> 'latin') AS best FROM m GROUP BY line_id)
SELECT line_id, CASE WHEN best >= 0.20 AND best > l + 0.10 THEN o WHEN l >= 0.15 THEN 'latin' ELSE o END AS pack_id FROM b""")
def route_script(spark, sf_dir):
    scores = _scores(spark, sf_dir).withColumn("confidence", F.col("confidence") * F.col("confidence") / 20000)
    return M.route(scores, ["line_id"])


def _matches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    every = _scores(spark, sf_dir).withColumns({"codepoint": (F.col("seq") * 100 + F.col("glyph_no")).cast("int"), "confidence": F.col("confidence") / 194})
    return every.where((F.col("line_id") % 21) == F.col("seq")).select("line_id", "glyph_no", "pack_id", "codepoint", "confidence"), every.select("line_id", "glyph_no", "pack_id", "codepoint", "confidence")


_FALLBACK = f"""every AS MATERIALIZED (SELECT line_id, glyph_no, s.pack_id, s.seq, s.seq * 100 + glyph_no AS codepoint, num / 194 AS confidence, threshold, cal_a, cal_b FROM scores s JOIN {PACKS} ON pk.pack_id = s.pack_id),
own AS MATERIALIZED (SELECT * FROM every WHERE line_id % 21 = seq),
alt AS MATERIALIZED (SELECT o.line_id, o.glyph_no, arg_max(e.seq, e.confidence * 1000000 - e.seq) AS seq FROM own o JOIN every e ON e.line_id = o.line_id AND e.glyph_no = o.glyph_no AND e.seq <> o.seq WHERE o.confidence < o.threshold GROUP BY ALL),
best AS (SELECT e.* FROM every e JOIN alt USING (line_id, glyph_no, seq)),
picked AS (SELECT o.line_id, o.glyph_no, CASE WHEN b.confidence > o.confidence THEN b.pack_id ELSE o.pack_id END AS pack_id, CAST(CASE WHEN b.confidence > o.confidence THEN b.codepoint ELSE o.codepoint END AS INTEGER) AS codepoint, CASE WHEN b.confidence > o.confidence THEN b.confidence ELSE o.confidence END AS confidence FROM own o LEFT JOIN best b USING (line_id, glyph_no))"""


@query(f"WITH {_SCORES}, {_FALLBACK} SELECT line_id, glyph_no, pack_id, codepoint, confidence FROM picked")
def mixed_fallback(spark, sf_dir):
    own, every = _matches(spark, sf_dir)
    return M.with_fallback(own, every, M.packs(spark), ["line_id", "glyph_no"])


@query(f"WITH {_SCORES}, {_FALLBACK} SELECT line_id, glyph_no, p.pack_id, codepoint, round(least(1.0, greatest(0.0, CAST(cal_a AS DOUBLE) * confidence + CAST(cal_b AS DOUBLE))), 9) AS confidence FROM picked p JOIN {PACKS} ON pk.pack_id = p.pack_id")
def calibrated_confidence(spark, sf_dir):
    own, every = _matches(spark, sf_dir)
    found = M.calibrated(M.with_fallback(own, every, M.packs(spark), ["line_id", "glyph_no"]), M.packs(spark))
    return found.select("line_id", "glyph_no", "pack_id", "codepoint", F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {_SCORES}, s AS (SELECT line_id, glyph_no, seq, num / 97.0 AS score, threshold FROM scores JOIN {PACKS} USING (pack_id, seq))
SELECT line_id, glyph_no, CAST(CASE WHEN max(score) < 0.9 THEN 63 ELSE arg_max(seq, score * 1000 - seq / 1000.0) END AS INTEGER) AS codepoint, CAST(max(score) AS DOUBLE) AS confidence FROM s GROUP BY line_id, glyph_no""")
def argmax_prototype(spark, sf_dir):
    scored = _scores(spark, sf_dir).select("line_id", "glyph_no", F.col("seq").alias("codepoint"), (F.col("confidence") / 97).alias("score"))
    return M.best_match(scored, ["line_id", "glyph_no"], F.lit(0.9)).select("line_id", "glyph_no", F.col("codepoint").cast("int").alias("codepoint"), "confidence")


_SHAPES = "SELECT line_key AS a, place AS b, k1 % 4 AS gh, k2 % 9 AS ge, k1 % 7 AS gj, size / 25 AS ga, (k1 + 1) % 4 AS ph, (k2 * 3) % 9 AS pe, (k1 * 5) % 7 AS pj, tilt * 20 AS pa FROM items"
_LIKE = "greatest(0, 1 - 0.25 * (abs(gh - ph) / 4 + abs(ge - pe) / 8 + abs(gj - pj) / 8 + abs(ga - pa) / 2))"


def _shapes(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir)
    return items.selectExpr("line_key as a", "place as b", "k1 % 4 as g_holes", "k2 % 9 as g_endpoints", "k1 % 7 as g_junctions", "size / 25 as g_aspect", "(k1 + 1) % 4 as p_holes", "(k2 * 3) % 9 as p_endpoints", "(k1 * 5) % 7 as p_junctions", "tilt * 20 as p_aspect", "k1 as g_bits", "k1 * 7 as p_bits")


@query(f"WITH {_ITEMS} SELECT a, b, round({_LIKE}, 9) AS likeness FROM ({_SHAPES})")
def struct_similarity(spark, sf_dir):
    return _shapes(spark, sf_dir).select("a", "b", F.round(M.likeness("g_", "p_"), 9).alias("likeness"))


@query(f"WITH {_ITEMS} SELECT a, b, round(0.55 * ncc + 0.25 * {_LIKE} + 0.20 * greatest(0, 1 - abs(ga - pa)), 9) AS score FROM (SELECT s.*, coalesce(bit_count(x & y) / nullif(bit_count(x | y), 0), 0) AS ncc FROM ({_SHAPES}) s JOIN (SELECT line_key AS a, place AS b, k1 AS x, k1 * 7 AS y FROM items) USING (a, b))")
def fused_score(spark, sf_dir):
    rows = _shapes(spark, sf_dir).withColumns({"w_ncc": F.lit(0.55), "w_struct": F.lit(0.25), "w_aspect": F.lit(0.20)})
    ncc = M.overlap(F.array("g_bits"), F.array("p_bits"))
    return rows.select("a", "b", F.round(M.fused("", ncc, M.likeness("g_", "p_"), M.aspect_likeness(F.col("g_aspect"), F.col("p_aspect"))), 9).alias("score"))


_POINTS = "(CASE CAST(k1 % 5 AS INTEGER) WHEN 0 THEN 1604 WHEN 1 THEN 1575 WHEN 2 THEN 1605 WHEN 3 THEN 1576 ELSE 1610 END)"


def _replaced(expr: str) -> str:
    """What the fold gives, for lines of at most eight letters, by replacing one pair from the left at a time in SQL."""
    pairs = "|".join(chr(a) + chr(b) for a, b, _ in registry.LIGATURES)
    out = f"regexp_replace({expr}, '({pairs})', '<\\1>', 'g')"
    for a, b, c in registry.LIGATURES:
        out = f"replace({out}, '<{chr(a)}{chr(b)}>', '{chr(c)}')"
    return out


@query(f"WITH {_ITEMS}, g AS (SELECT line_key AS line_id, string_agg(chr({_POINTS}), '' ORDER BY place) AS s FROM items GROUP BY line_key) SELECT line_id, {_replaced('s')} AS letters FROM g")
def ligature_merge(spark, sf_dir):
    items = _items(spark, sf_dir).select(F.col("line_key").alias("line_id"), F.col("place").alias("glyph_no"), F.expr(_POINTS).alias("codepoint"))
    return M.ligatures(items, ["line_id"]).select("line_id", F.array_join(F.transform("points", T.character), "").alias("letters"))


_BOX_COLUMNS = ("line_key AS image_id", "place AS glyph_no", "CAST(place * 20 + k1 % 17 AS INTEGER) AS x", "CAST(3 + k2 % 12 AS INTEGER) AS w", "CAST(CASE k1 % 6 WHEN 0 THEN 0 WHEN 1 THEN 63 ELSE 97 + k1 % 26 END AS INTEGER) AS codepoint", "sure AS confidence")
_BOXES = f"SELECT {', '.join(_BOX_COLUMNS)} FROM items"


@query(f"""WITH {_ITEMS}, g AS (SELECT *, lag(x) OVER o AS px, lag(w) OVER o AS pw FROM ({_BOXES}) WINDOW o AS (PARTITION BY image_id ORDER BY glyph_no))
SELECT image_id, string_agg(CASE WHEN x - (px + pw) > greatest(least(pw, w), 4) THEN ' ' ELSE '' END || CASE WHEN codepoint IN (0, 63) THEN '' ELSE chr(codepoint) END, '' ORDER BY glyph_no) AS ocr_text, round(avg(confidence), 9) AS mean_confidence, CAST(count(*) AS INTEGER) AS glyph_count FROM g GROUP BY image_id""")
def gap_spacing(spark, sf_dir):
    boxes = _items(spark, sf_dir).selectExpr(*_BOX_COLUMNS)
    return M.spelt(boxes, ["image_id"], ["glyph_no"]).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(f"WITH {_ITEMS} SELECT line_id, glyph_no AS was, CASE WHEN rtl = 1 THEN max(glyph_no) OVER (PARTITION BY line_id) - glyph_no ELSE glyph_no END AS glyph_no FROM (SELECT line_key AS line_id, place AS glyph_no, line_key % 21 AS seq FROM items) JOIN {PACKS} USING (seq)")
def rtl_order(spark, sf_dir):
    names = F.array(*(F.lit(p[0]) for p in registry.PACKS))
    items = _items(spark, sf_dir).select(F.col("line_key").alias("line_id"), F.col("place").alias("glyph_no"), F.col("place").alias("was"), F.element_at(names, (F.col("line_key") % 21 + 1).cast("int")).alias("pack_id"))
    return M.right_to_left(items, M.packs(spark), ["line_id"]).select("line_id", "was", "glyph_no")


@query(f"WITH {_ITEMS} SELECT line_key AS line_id, (list_sort(list(size)))[len(list(size)) // 2 + 1] AS median_w FROM items GROUP BY line_key")
def upper_median(spark, sf_dir):
    return M.upper_median(_items(spark, sf_dir).withColumnRenamed("line_key", "line_id"), ["line_id"], "size", "median_w")


@query("SELECT pack_id, bitmap, min(proto_no) AS proto_no FROM (SELECT p_brand AS pack_id, p_size AS bitmap, p_partkey AS proto_no FROM part) GROUP BY pack_id, bitmap")
def prototype_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as pack_id", "p_size as bitmap", "p_partkey as proto_no")
    return M.distinct_prototypes(rows).select("pack_id", "bitmap", "proto_no")


# Detection over drawn pages: every fifth page is blank, and hints are missing, without a letter, or the text.
_READ = f"replace(replace({_CAPITALS}, 'II', 'I I'), 'II', 'I I')"
_DETECTED = f"""d AS (SELECT item_id AS image_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE {_READ} END AS read, CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '12 !' ELSE {_CAPITALS} END AS hint FROM benchmark)"""


def _detected(spark, sf_dir, **options) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    said = _capitals()
    hint = F.when(F.col("item_id") % 3 == 1, "12 !").when(F.col("item_id") % 3 == 2, said)
    rows = items.select(F.col("item_id").alias("image_id"), F.when(F.col("item_id") % 5 == 0, "").otherwise(said).alias("text"), hint.alias("hint"))
    drawn = ocr.draw_terminal(rows.select("image_id", "text").repartition(2 * spark.sparkContext.defaultParallelism))
    return detect.detect_images(drawn.join(rows.select("image_id", "hint"), "image_id"), [ocr.latin_pack()], "hint", **options)


@query(f"""WITH {_DETECTED} SELECT image_id, CASE WHEN read = '' AND image_id % 3 = 2 THEN hint ELSE read END AS text, read AS ocr_text, CASE WHEN image_id % 3 < 2 THEN 'ocr' WHEN read = '' THEN 'unicode' ELSE 'hybrid' END AS identification_source,
read = '' AND image_id % 3 = 2 AS fallback_used, CASE WHEN read <> '' OR image_id % 3 = 2 THEN 'en' END AS top_code, CAST(len(replace(read, ' ', '')) AS INTEGER) AS glyph_count FROM d""")
def detection_results(spark, sf_dir):
    top = F.get("languages", F.lit(0))["code"].alias("top_code")
    return _detected(spark, sf_dir).select("image_id", "text", "ocr_text", "identification_source", "fallback_used", top, "glyph_count")


@query(f"""WITH {_DETECTED}, e AS (SELECT item_id AS image_id, {_CAPITALS} AS sample FROM benchmark)
SELECT image_id, (read <> '' OR image_id % 3 = 2) AND lower(replace(read, ' ', '')) = lower(replace(sample, ' ', '')) AND NOT (read = '' AND image_id % 3 = 2) AS ok FROM d JOIN e USING (image_id)""")
def round_trip_check(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    said = _capitals()
    expected = items.select(F.col("item_id").alias("image_id"), F.lit("en").alias("lang"), said.alias("sample_text"))
    return detect.circle(_detected(spark, sf_dir), expected, strict=True).select("image_id", "ok")


@query(f"""WITH {_DETECTED}, e AS (SELECT item_id AS image_id, lower(replace({_CAPITALS}, ' ', '')) AS a FROM benchmark), g AS (SELECT a, lower(replace(read, ' ', '')) AS b FROM d JOIN e USING (image_id))
SELECT 'en' AS lang, count(*) AS strings, CAST(sum(levenshtein(a, b)) AS BIGINT) AS errors, CAST(sum(len(a)) AS BIGINT) AS chars, sum(levenshtein(a, b)) / sum(len(a)) <= 0.05 AS passed FROM g""")
def corpus_error_report(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    said = _capitals()
    expected = items.select(F.col("item_id").alias("image_id"), F.lit("en").alias("lang"), said.alias("sample_text"))
    return detect.corpus_report(_detected(spark, sf_dir), expected).select("lang", "strings", "errors", "chars", "passed")


@query(f"""WITH {_INK}, n AS (SELECT image_id, len(replace(s, ' ', '')) AS glyphs FROM t)
SELECT image_id, CAST(0 AS INTEGER) AS line_no, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) + 1 AS INTEGER) AS x1, CAST(max(y) + 1 AS INTEGER) AS y1, max(glyphs) AS glyphs FROM dots_on JOIN n USING (image_id) GROUP BY image_id""")
def page_lines(spark, sf_dir):
    """Glyph rows summed up to the lines of drawn pages."""
    glyphs = ocr.read_glyphs(_pages(spark, sf_dir), [ocr.latin_pack()])
    return glyphs.groupBy("image_id", "line_no").agg(F.min("page_x").alias("x0"), F.min("page_y").alias("y0"), F.max(F.col("page_x") + F.col("w")).alias("x1"), F.max(F.col("page_y") + F.col("h")).alias("y1"), F.count("*").alias("glyphs"))
