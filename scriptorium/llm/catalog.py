"""Registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions.cluster import ship
from scriptorium.llm import decontaminate, langid, pieces, pii, quality, secrets, simhash, substring, tiff, warc
from scriptorium.llm.shared import use_checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(_table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.classify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_table(spark, sf_dir, "documents"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.image_digests(tiff.read_pages(tiff.write_media(_table(spark, sf_dir, "documents"))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_checkpoint_dir(spark)
    archives = warc.write_archives(_table(spark, sf_dir, "pages")).checkpoint()
    found = warc.read_archives(archives).where("record_type <> 'warcinfo' OR error IS NOT NULL")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return found.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    every = found.withColumn("every", F.expr("array_sort(concat(base, added))"))
    return every.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("every").alias("spans"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 finds by patterns alone, without the field's spans: this much SQL can say."""
    return pii.digests(pii.find_pii(_table(spark, sf_dir, "documents"))).drop("spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 finds by patterns alone, without the spans of high entropy: this much SQL can say."""
    return op10_secrets(spark, sf_dir).drop("spans")


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_langid": op5_langid,
    "op6_substring": op6_substring,
    "op7_tiff": op7_tiff,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "pii_base_spans": pii_base_spans,
    "secret_base_spans": secret_base_spans,
}


def _matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    """SQL for the spans (doc_id, kind, rank, s, e) of a pattern's matches m, leftmost and non-overlapping: places are sums of
    the lengths of what lies between the matches and of the matches."""
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, s, s + len(m) AS e FROM (SELECT r, m, CAST(sum(len(gap) + len(m)) OVER (PARTITION BY r ORDER BY i) - len(m) AS BIGINT) AS s
FROM (SELECT r, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {pattern}) AS ms, regexp_split_to_array(text, {pattern}) AS gaps FROM d))) WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[len({_DIGITS}) + 1 - i] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + CAST({_DIGITS}[len({_DIGITS}) + 1 - i] AS INTEGER)] END)) % 10 = 0"
_D = "d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
_SPANNED = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})"

ORACLES = {
    "pii_base_spans": f"""
WITH {_D}, spans AS (
{_matches("email", 1, "'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'", "true")}
UNION ALL {_matches("ip", 2, "'[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)'", "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255")}
UNION ALL {_matches("card", 3, "'[0-9](?:[ -]?[0-9])+'", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
UNION ALL {_matches("phone", 4, "'\\+[0-9][ ().0-9-]+[0-9]'", f"len({_DIGITS}) BETWEEN 8 AND 15")}),
t AS (SELECT r, count(*) FILTER (WHERE rank = 1) AS n_email, count(*) FILTER (WHERE rank = 2) AS n_ip, count(*) FILTER (WHERE rank = 3) AS n_card, count(*) FILTER (WHERE rank = 4) AS n_phone, {_SPANNED.format(order="rank, s")} AS said FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN t USING (r)
""",
    "secret_base_spans": f"""
WITH {_D}, spans AS (
{_matches("assign", 1, "'(?i:password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"'']?[A-Za-z0-9+/_.=-]+'", "len(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 12")}
UNION ALL {_matches("access", 2, "'AKIA[A-Z0-9]+'", "len(m) >= 18")}
UNION ALL {_matches("hex", 3, "'[0-9a-f]+'", "len(m) >= 16")}),
t AS (SELECT r, count(*) FILTER (WHERE rank = 1) AS n_assign, count(*) FILTER (WHERE rank = 2) AS n_access, count(*) FILTER (WHERE rank = 3) AS n_hex, {_SPANNED.format(order="s, rank")} AS said FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM d LEFT JOIN t USING (r)
""",
    "op3_decontaminate": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, ws, least(10, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, list_aggregate(ws[p:p + n - 1], 'string_agg', ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, p, n, list_aggregate(ws[p:p + n - 1], 'string_agg', ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, ns WHERE len(ws) >= n)),
m AS (SELECT r, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""",
    "op6_substring": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, p, hash(ws[p:p + 19]) AS h, hash(list_reverse(ws[p:p + 19])) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 18)) AS p FROM d)),
f AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY h, k ORDER BY r, p) AS n FROM g) WHERE n > 1),
c AS (SELECT r, list(DISTINCT x) AS gone FROM (SELECT r, unnest(range(p, p + 20)) AS x FROM f) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_select(ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))), ' ') END) AS kept_sha256
FROM d LEFT JOIN c USING (r)
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM p JOIN m USING (h)
""",
}
