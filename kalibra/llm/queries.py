"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, language, language_model, lines, near, neighbours, packing, quality, secret_scan, sharding, spelling, urls
from .tables import materialise, table


def remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, blanks_cut=True, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.with_checksum(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_repeated(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cleaned.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Fixed by the query's definition.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents, remainder("doc_id", 4) != 2)
    found = language.identify(documents, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.facts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    filters = {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct").cast("long") < 80 * F.col("n_words").cast("long"),
        "C": 100 * F.col("n_upper").cast("long") > 10 * F.col("n_chars").cast("long"),
        "D": F.col("has_symbol"),
        "E": F.col("is_copy"),
    }
    found = filter_audit.audit(materialise(rows, "audit-rows"), filters, "part", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
    return found.drop("filter")


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = f"translate(%s, '{urls.UPPER}', '{urls.LOWER}')"
SQL: dict[str, str] = {}

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SQL["op2_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWER % "coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.reached) AS component_id, s.doc_id = min(r.reached) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.sh"""

SQL["op3_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS (SELECT r, i, w[i:i + 7] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
hit AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM x) t, (SELECT unnest(range(8)) AS k) k WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
l AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) t GROUP BY r),
m AS (SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS mean, var_pop(f / n) AS v, avg(1 / n) AS inv FROM h),
pr AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, 1e-6) - 1, 1), 1000) AS k FROM q),
ok AS (SELECT source, (f + mean * k) / (n + k) <= least(0.5, greatest(0.2, mean + 1.645 * sqrt(mean * (1 - mean) / (k + 1)))) AS host_ok FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_ok, true) AS kept
FROM b LEFT JOIN ok USING (source)"""

SQL["op5_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d),
x AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM n),
k AS (SELECT r, i, line, {LOWER % f"trim(line, {SPACE})"} AS key FROM x),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.r, k.i, k.line, bad.key IS NOT NULL AS gone FROM k LEFT JOIN bad USING (key)),
g AS (SELECT r, count(*) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM j GROUP BY r)
SELECT d.doc_id, g.n_lines::BIGINT AS n_lines, g.n_dropped::BIGINT AS n_dropped, sha256(g.kept) AS kept_sha256 FROM g JOIN d USING (r)"""

SQL["op6_url_filters"] = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {LOWER % f"regexp_extract(coalesce(url, ''), '{urls.HOST}', 1)"} AS host,
  regexp_extract(coalesce(url, ''), '{urls.PATH}', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{t[: t.index('/')]}', '{t[t.index('/') :]}', '{v}')" for v, t in URL_RULES)}) AS v(rule, rh, rp, verdict)),
m AS (SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, length(rh) DESC) AS n
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (r)"""

SQL["op8_nearest_neighbours"] = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM t WHERE n <= 20"""

SQL["op11_filter_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count_if(good) AS g, count_if(toxic) AS t FROM m GROUP BY part, fails),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS done FROM (SELECT *, unnest(range(1, 6)) AS step FROM o) t),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (done | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & done = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & done > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & done = 0 AND fails & bit > 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN fails & done = 0 AND fails & bit > 0 THEN t ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

CRC32 = """xor(list_reduce(list_transform(range(length(%s) // 2), lambda i: 16 * (instr('0123456789ABCDEF', %s[2 * i + 1]) - 1) + instr('0123456789ABCDEF', %s[2 * i + 2]) - 1),
  lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""

SQL["op13_spelling_variants"] = f"""
WITH RECURSIVE codes AS (SELECT list(code ORDER BY i) AS codes FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS code FROM range(256) t(i)) u),
r AS (SELECT doc_id, unnest(regexp_extract_all({LOWER % "coalesce(text, '')"}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run) t),
h AS (SELECT run, n, {CRC32 % ("x", "x", "x")} AS h FROM c, codes),
m AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS l FROM m GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
v AS (SELECT word, n, l, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM w) t),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
t(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(t.root, t.step) AS root, n, n_near, form_n FROM f JOIN t USING (word) GROUP BY f.word, form, n, n_near, form_n"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
