"""Queries over texts, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from scriptorium.functions import registry
from scriptorium.functions.cluster import ship
from scriptorium.operators import text as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LATIN = "abcdefghijklmnopqrstuvwxyz"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, alias: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") AS {alias}"


# The DuckDB side.
LANGS = values([(i, c, n) for i, (c, n) in enumerate(zip(registry.CODES, registry.NAMES, strict=True))], "l(seq, code, name)")
RANGES = values([(x[0], lo, hi) for x in registry.LANGUAGES for lo, hi in x[4]], "r(code, lo, hi)")
WIDE = values([*((x[0], lo, hi) for x in registry.LANGUAGES for lo, hi in x[4]), *(("en", lo, hi) for lo, hi in registry.fallback())], "r(code, lo, hi)")
VOTES = values(registry.pack_ranges(), "v(pack, lo, hi)")
LETTERS = values([(i, registry.letters_of(c)) for i, c in enumerate(registry.CODES)], "s(k, letters)")
WS = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
MIXED = f"mixed AS (SELECT doc_id, source, CASE WHEN k = 0 THEN text ELSE translate(text, '{LATIN}', letters) END AS text FROM documents JOIN {LETTERS} ON k = doc_id % 21)"


def counts_sql(source: str, keys: str, text: str = "text") -> str:
    """CTEs ch and counted (keys, code, n) from a table."""
    return f"""ch AS (SELECT {keys}, c, count(*) AS m FROM (SELECT {keys}, unnest(string_split({text}, '')) AS c FROM {source}) WHERE regexp_matches(c, '\\p{{L}}') GROUP BY {keys}, c),
counted AS (SELECT {keys}, code, CAST(sum(m) AS BIGINT) AS n FROM ch JOIN {WIDE} ON unicode(c) BETWEEN lo AND hi GROUP BY {keys}, code)"""


PERCENT = "percents AS (SELECT *, CAST(round_even(n / sum(n) OVER (PARTITION BY doc_id) * 100, 0) AS INTEGER) AS percent FROM counted)"
RANKED = f"ranks AS (SELECT p.*, l.name, row_number() OVER (PARTITION BY doc_id ORDER BY percent DESC, l.name) AS rank FROM percents p JOIN {LANGS} ON l.code = p.code)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their small Latin letters turned into those of one of the 21 scripts, by id."""
    sets = ", ".join(f"'{registry.letters_of(c)}'" for c in registry.CODES)
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(f"CASE WHEN doc_id % 21 = 0 THEN text ELSE translate(text, '{LATIN}', element_at(array({sets}), cast(doc_id % 21 + 1 AS int))) END").alias("text"))


def exploded(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rank, code, name, percent of the ranked languages; each text is profiled once, see ``T.letter_counts``."""
    return T.detect_languages(df).select(key, F.posexplode_outer("languages").alias("i", "l")).where("i IS NOT NULL").select(key, (F.col("i") + 1).cast("long").alias("rank"), "l.code", "l.name", "l.percent")


@query(f"WITH {counts_sql('documents', 'doc_id')} SELECT doc_id, code, n FROM counted")
def lang_counts_by_doc(spark, sf_dir):
    return T.letter_counts(table(spark, sf_dir, "documents"), ["doc_id"])


@query(f"WITH {MIXED}, {counts_sql('mixed', 'doc_id')} SELECT doc_id, code, n FROM counted")
def lang_counts_by_join(spark, sf_dir):
    return T.counts_by_join(mixed(spark, sf_dir), ["doc_id"])


@query(f"WITH {MIXED}, {counts_sql('mixed', 'doc_id')} SELECT doc_id, code, n FROM counted")
def lang_counts_by_patterns(spark, sf_dir):
    docs = mixed(spark, sf_dir).select("doc_id", F.posexplode(T.counts_by_patterns("text")).alias("k", "n"))
    codes = F.array(*map(F.lit, registry.CODES))
    return docs.where("n > 0").select("doc_id", F.element_at(codes, F.col("k") + 1).alias("code"), F.col("n").cast("long").alias("n"))


@query(f"WITH {MIXED}, {counts_sql('mixed', 'doc_id')}, {PERCENT} SELECT doc_id, code, percent FROM percents")
def lang_percent_by_doc(spark, sf_dir):
    return exploded(mixed(spark, sf_dir)).select("doc_id", "code", "percent")


@query(f"WITH {MIXED}, {counts_sql('mixed', 'doc_id')}, {PERCENT}, {RANKED} SELECT doc_id, rank, code, name, percent FROM ranks")
def lang_rank(spark, sf_dir):
    return exploded(mixed(spark, sf_dir))


@query(f"WITH {MIXED}, {counts_sql('mixed', 'doc_id')}, {PERCENT}, {RANKED} SELECT d.doc_id, code AS top_code, name AS top_name, percent FROM mixed d LEFT JOIN (SELECT * FROM ranks WHERE rank = 1) USING (doc_id)")
def top_language(spark, sf_dir):
    first = F.get("languages", F.lit(0))
    return T.detect_languages(mixed(spark, sf_dir)).select("doc_id", first["code"].alias("top_code"), first["name"].alias("top_name"), first["percent"].alias("percent"))


@query(f"WITH {MIXED}, {counts_sql('mixed', 'doc_id')}, {PERCENT}, {RANKED} SELECT code, count(*) AS docs, count(*) FILTER (WHERE rank = 1) AS top_docs, CAST(sum(n) AS BIGINT) AS letters FROM ranks GROUP BY code")
def mixed_script_distribution(spark, sf_dir):
    codes = F.array(*map(F.lit, registry.CODES))
    docs = mixed(spark, sf_dir).select(T.profile("text")["counts"].alias("counts"))
    ranks = docs.select("counts", F.posexplode(T.ranked(F.col("counts"))).alias("i", "l"))
    n = F.element_at("counts", F.array_position(codes, F.col("l.code")).cast("int"))
    return ranks.groupBy("l.code").agg(F.count("*").alias("docs"), F.count_if(F.col("i") == 0).alias("top_docs"), F.sum(n).cast("long").alias("letters"))


@query(f"WITH {MIXED}, {counts_sql('mixed', 'source')} SELECT source, code, n, n / sum(n) OVER (PARTITION BY source) AS share FROM counted")
def corpus_language_mix(spark, sf_dir):
    counts = T.letter_counts(mixed(spark, sf_dir), ["source"])
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


@query(f"WITH {counts_sql('conversations', 'role')} SELECT role, code, n FROM counted")
def conversation_language_by_role(spark, sf_dir):
    return T.letter_counts(table(spark, sf_dir, "conversations"), ["role"])


@query(f"WITH {counts_sql('pages', 'page_id', 'html')} SELECT page_id, code, n FROM counted")
def page_language(spark, sf_dir):
    return T.letter_counts(table(spark, sf_dir, "pages"), ["page_id"], "html")


_PROBES = [(i, chr(cp)) for i, cp in enumerate([0x250, 0x1D00, 0x1E9E, 0xFB01, 0xFF21, 0x2C2E, 0x212A, 0xAA, 0xB5, 0x2B0, 0x10CB0, 0x1DF00, 0x3042, 0x4E00, 0xAC00, 0x1C90, 0xFB1D, 0x2DE0, 0xD7, 0x5F, 0x660, 0x93F, 0x8B5, 0xC5D, 0xCDD, 0x41, 0x24F, 0x250])]


@query(f"SELECT i, c, coalesce((SELECT min(code) FROM {WIDE} WHERE unicode(c) BETWEEN lo AND hi AND regexp_matches(c, '\\p{{L}}')), 'none') AS code FROM {values(_PROBES, 'p(i, c)')}")
def letter_language_probes(spark, sf_dir):
    """Letters in and outside the ranges: the fallback by Latin name, gaps, marks and digits."""
    ship(spark)
    rows = spark.createDataFrame(_PROBES, "i int, c string")
    return T.detect_languages(rows, "c").select("i", "c", F.coalesce(F.get("languages", F.lit(0))["code"], F.lit("none")).alias("code"))


@query(f"WITH {MIXED} SELECT doc_id, regexp_matches(text, '\\p{{L}}') AS has_letter, NOT regexp_matches(text, '[^\\x20-\\x7E\\x09-\\x0D\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]') AND regexp_matches(text, '{NOT_WS}') AS ascii_ocr FROM mixed")
def text_flags(spark, sf_dir):
    return mixed(spark, sf_dir).withColumn("p", T.profile("text")).select("doc_id", "p.has_letter", "p.ascii_ocr")


@query(f"""WITH {MIXED}, c AS (SELECT DISTINCT doc_id, c FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM mixed) WHERE regexp_matches(c, '\\p{{L}}')),
bad AS (SELECT DISTINCT doc_id FROM c WHERE NOT EXISTS (SELECT 1 FROM {RANGES} WHERE unicode(c) BETWEEN lo AND hi))
SELECT m.doc_id, regexp_matches(text, '{NOT_WS}') AND (bad.doc_id IS NULL OR NOT regexp_matches(text, '[^\\x09-\\x0D\\x1C-\\x7E]')) AS native_ocr FROM mixed m LEFT JOIN bad USING (doc_id)""")
def native_ocr_flags(spark, sf_dir):
    return mixed(spark, sf_dir).withColumn("p", T.profile("text")).select("doc_id", "p.native_ocr")


_VOTED = f"""{MIXED}, words AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, ws[pos] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM mixed))),
letters AS (SELECT doc_id, pos, c, i FROM (SELECT doc_id, pos, unnest(string_split(w, '')) AS c, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE regexp_matches(c, '\\p{{L}}')),
voted AS (SELECT doc_id, pos, pack, count(*) AS n, min(i) AS first FROM letters LEFT JOIN {VOTES} ON unicode(c) BETWEEN lo AND hi GROUP BY doc_id, pos, pack),
best AS (SELECT doc_id, pos, CASE WHEN count(*) FILTER (WHERE pack IS NULL) = 0 THEN arg_max(pack, n * 1000000 - first) END AS pack FROM voted GROUP BY doc_id, pos),
pack AS (SELECT w.doc_id, w.pos, w.w, CASE WHEN regexp_matches(w, '{NOT_WS}') AND NOT regexp_matches(w, '[^\\x09-\\x0D\\x1C-\\x7E]') THEN 'latin' ELSE best.pack END AS pack_id FROM words w LEFT JOIN best USING (doc_id, pos))"""


def _words(spark, sf_dir) -> DataFrame:
    words = mixed(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return words.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "w").withColumn("p", T.profile("w", short=True))


@query(f"WITH {_VOTED} SELECT doc_id, pos, pack_id FROM pack")
def pack_id_for_text(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "pos", "p.pack_id")


@query(f"WITH {_VOTED} SELECT doc_id % 21 AS k, coalesce(pack_id, 'none') AS pack_id, count(*) AS words FROM pack GROUP BY ALL")
def pack_by_lang_matrix(spark, sf_dir):
    return _words(spark, sf_dir).groupBy((F.col("doc_id") % 21).alias("k"), F.coalesce("p.pack_id", F.lit("none")).alias("pack_id")).agg(F.count("*").alias("words"))


@query(f"WITH {_VOTED} SELECT doc_id, pos, CASE WHEN pack_id = 'latin' THEN 'terminal_ppm' WHEN pack_id IS NOT NULL THEN 'ocr_png' ELSE 'unicode_png' END AS renderer FROM pack")
def renderer_choice(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", "pos", T.renderer(F.col("p")).alias("renderer"))


@query("""SELECT doc_id, h, o, CASE WHEN hint IS NULL OR NOT regexp_matches(hint, '\\p{L}') THEN 'ocr' WHEN regexp_matches(ocr, '\\S') THEN 'hybrid' ELSE 'unicode' END AS identification_source
FROM (SELECT doc_id, h, o, CASE h WHEN 1 THEN '12 !' WHEN 2 THEN source WHEN 3 THEN '  ' END AS hint, CASE o WHEN 1 THEN lang ELSE ' ' END AS ocr FROM documents, (SELECT unnest(range(4)) AS h), (SELECT unnest(range(2)) AS o))""")
def identification_source_matrix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("h")).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")))
    hint = F.when(F.col("h") == 1, "12 !").when(F.col("h") == 2, F.col("source")).when(F.col("h") == 3, "  ")
    docs = docs.withColumns({"hint": hint, "ocr": F.when(F.col("o") == 1, F.col("lang")).otherwise(" ")})
    return docs.withColumn("p", T.profile("hint", short=True)).select("doc_id", "h", "o", T.identification(F.col("ocr"), F.col("hint"), F.col("p")).alias("identification_source"))


_DRESS = "chr(8220) || ' ' || text || chr(8217) || chr(187) || chr(160) || ' '"


@query(f"SELECT doc_id, translate(regexp_replace({_DRESS}, '^{WS}+|{WS}+$', '', 'g'), '“”«»‘’', '\"\"\"\"''''') AS plain FROM documents")
def quote_normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normal_quotes(F.concat(F.lit("“ "), "text", F.lit("’»  "))).alias("plain"))


@query(f"SELECT doc_id, lower(regexp_replace(replace(nfc_normalize(text), 'ß', 'ss'), '{WS}+', '', 'g')) AS folded FROM documents")
def nfc_casefold_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.folded("text").alias("folded"))


@query("SELECT doc_id, replace(text, ' ', '') AS bare FROM documents")
def english_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("bare"))


_LINES = "lines AS (SELECT doc_id, i, l FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r\\n|[\\x0A-\\x0D\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_matches(x, '\\S')) AS ls FROM documents)))"


@query(f"WITH {_LINES} SELECT doc_id, i AS line_no, l AS line FROM lines")
def nonblank_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of("text")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(f"WITH {_LINES} SELECT doc_id, regexp_replace(l, '^{WS}+|{WS}+$', '', 'g') AS sample FROM lines WHERE i = 1")
def first_nonblank_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.stripped(F.get(T.lines_of("text"), F.lit(0))).alias("sample")).where("sample IS NOT NULL")


_REGISTRY = values([(i, x[0], x[1], x[2], ";".join(x[3]), x[5], ord(x[5])) for i, x in enumerate(registry.LANGUAGES)], "g(seq, code, name, script, regions, sample_char, sample_cp)")


@query(f"SELECT seq, code, name, script, regions, sample_char, true AS ocr_native FROM {_REGISTRY}")
def registry_list(spark, sf_dir):
    return registry.languages(spark).select("seq", "code", "name", "script", F.array_join("regions", ";").alias("regions"), "sample_char", "ocr_native")


@query(f"SELECT asked, name FROM (VALUES ('RU'), ('hi'), ('zz'), ('En')) a(asked) LEFT JOIN {_REGISTRY} ON code = lower(asked)")
def registry_lookup(spark, sf_dir):
    asked = spark.createDataFrame([("RU",), ("hi",), ("zz",), ("En",)], "asked string")
    known = registry.languages(spark).select("code", "name")
    return asked.join(F.broadcast(known), F.lower("asked") == known.code, "left").select("asked", "name")


@query(f"SELECT count(*) AS total_supported, 21 AS target_ambition, count(*) AS script_detection_count, count(*) AS ocr_native_count, CAST(0 AS BIGINT) AS script_only_count, count(*) >= 21 AS meets_goal, string_agg(code, ',' ORDER BY seq) AS codes FROM {LANGS}")
def coverage_summary(spark, sf_dir):
    native = F.count_if("ocr_native")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]), ",")
    return registry.languages(spark).agg(F.count("*").alias("total_supported"), F.lit(21).alias("target_ambition"), F.count("*").alias("script_detection_count"), native.alias("ocr_native_count"), (F.count("*") - native).alias("script_only_count"), (F.count("*") >= 21).alias("meets_goal"), codes.alias("codes"))


@query(f"SELECT code, lo AS start_cp, hi AS end_cp, 'U+' || upper(lpad(to_hex(lo), CAST(greatest(4, len(to_hex(lo))) AS INTEGER), '0')) AS start_hex, 'U+' || upper(lpad(to_hex(hi), CAST(greatest(4, len(to_hex(hi))) AS INTEGER), '0')) AS end_hex FROM {RANGES}")
def script_ranges(spark, sf_dir):
    return registry.ranges(spark).select("code", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), T.u_plus("start").alias("start_hex"), T.u_plus("end").alias("end_hex"))


@query(f"WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) SELECT unicode(c) AS cp, c AS ch, (SELECT min(code) FROM {RANGES} WHERE unicode(c) BETWEEN lo AND hi) AS code FROM c")
def codepoint_language(spark, sf_dir):
    points = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).distinct().select(F.ascii("c").alias("cp"))
    return points.select("cp", T.character("cp").alias("ch"), T.language_of_point("cp").alias("code"))


@query(f"""WITH {MIXED}, {counts_sql('mixed', 'doc_id')}, {PERCENT}, {RANKED},
j AS (SELECT doc_id, string_agg('{{"code":"' || code || '","name":"' || name || '","percent":' || percent || ',"reliable":true}}', ',' ORDER BY rank) AS js FROM ranks GROUP BY doc_id)
SELECT m.doc_id, '[' || coalesce(js, '') || ']' AS languages_json FROM mixed m LEFT JOIN j USING (doc_id)""")
def languages_json(spark, sf_dir):
    return T.detect_languages(mixed(spark, sf_dir)).select("doc_id", F.to_json("languages").alias("languages_json"))


@query(f"""WITH {MIXED}, {counts_sql('mixed', 'doc_id')}, {PERCENT}, {RANKED},
j AS (SELECT doc_id, string_agg('{{"code":"' || code || '","name":"' || name || '","percent":' || percent || ',"reliable":true}}', ',' ORDER BY rank) AS js FROM ranks GROUP BY doc_id)
SELECT m.doc_id, '{{"text":' || CAST(to_json(text) AS VARCHAR) || ',"languages":[' || coalesce(js, '') || '],"mean_confidence":0.0,"glyph_count":0,"ocr_text":"","identification_source":"unicode"}}' AS result_json FROM mixed m LEFT JOIN j USING (doc_id)""")
def result_json(spark, sf_dir):
    return T.result(mixed(spark, sf_dir)).select("doc_id", F.to_json("result").alias("result_json"))


# Every word of a text is a string to be recognised; what was recognised stands in as the word without q, with tn for th and a
# full stop doubled.  DuckDB's levenshtein counts edits by bytes, so on its side letters outside ASCII, of which none is edited,
# stand as one ASCII sign for each: that changes no distance.
_PAIRS = """pairs AS (SELECT lang, source, a, replace(replace(translate(a, 'q', ''), 'th', 'tn'), '.', '..') AS b
FROM (SELECT lang, source, unnest(string_split(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g'), ' ')) AS a FROM documents))"""


def _recognised(docs: DataFrame) -> DataFrame:
    words = docs.select("lang", "source", F.explode(F.split("text", " ")).alias("a"))
    return words.withColumn("b", F.replace(F.replace(F.translate("a", "q", ""), F.lit("th"), F.lit("tn")), F.lit("."), F.lit("..")))


@query(f"""WITH {_PAIRS} SELECT source, count(*) AS strings, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS failures, CAST(sum(levenshtein(a, b)) AS BIGINT) AS errors,
CAST(sum(len(a)) AS BIGINT) AS chars, sum(levenshtein(a, b)) / greatest(sum(len(a)), 1) AS cer FROM pairs GROUP BY source""")
def cer_by_group(spark, sf_dir):
    return T.error_rate(_recognised(table(spark, sf_dir, "documents")), ["source"], "a", "b")


@query(f"""WITH {_PAIRS}, c AS (SELECT lang, sum(levenshtein(a, b)) / greatest(sum(len(a)), 1) AS cer FROM pairs GROUP BY lang)
SELECT lang, cer, coalesce(max_cer, 0.05) AS max_cer, cer <= coalesce(max_cer, 0.05) AS passed FROM c LEFT JOIN {values([(k, v) for k, v in registry.ERROR_BUDGET.items()], 'b(code, max_cer)')} ON code = lang""")
def cer_budget_gate(spark, sf_dir):
    rate = T.error_rate(_recognised(table(spark, sf_dir, "documents")), ["lang"], "a", "b")
    budget = registry.budgets(spark)
    limit = F.coalesce("max_cer", F.lit(0.05))
    return rate.join(F.broadcast(budget), rate.lang == budget.code, "left").select("lang", "cer", limit.alias("max_cer"), (F.col("cer") <= limit).alias("passed"))
