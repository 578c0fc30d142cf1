"""Retrieval, page and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import noise
from ..functions import text as tx
from ..operators import frames, linked, match, pages, sequence, similar
from ..sources import caljson, cdfx
from . import derived, samples
from .registry import load, query

SCORED = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, 1 - list_cosine_similarity(q.v, e.v) AS d FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS place FROM s) t WHERE place <= 50)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest vectors of every vector whose id is divisible by 50, whatever their label."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return match.nearest_in_tiles(vectors, F.col("vec_id") % 50 == 0, 50).withColumnsRenamed({"distance": "d", "rank": "place"})


@query(SCORED + """, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY d, vec_id) AS k FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM b WHERE k = 1)
SELECT query_id, label, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 3""")
def unique_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = pool(spark, sf_dir).groupBy("query_id", "label").agg(F.min(F.struct("d", "vec_id")).alias("b")).select("query_id", "label", "b.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return best.withColumn("rank", rank).where("rank <= 3").select("query_id", "label", "vec_id", F.round("d", 6).alias("distance"), "rank")


@query(SCORED + " SELECT query_id, vec_id, place FROM p WHERE label = 3")
def filter_after_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).where("label = 3").select("query_id", "vec_id", "place")


@query("""WITH n AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 2 = 0) t GROUP BY label, i),
q AS (SELECT label, list(m ORDER BY i) AS v FROM n GROUP BY label), s AS (SELECT q.label, e.vec_id, 1 - list_cosine_similarity(q.v, list_transform(e.embedding, lambda x: x::DOUBLE)) AS d
FROM q JOIN embeddings e ON q.label = e.label WHERE e.vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM s)
SELECT label, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""")
def two_stage_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a label's new vectors asks for its nearest old ones."""
    vectors = load(spark, sf_dir, "embeddings")
    asked = match.mean_vector(vectors.where("vec_id % 2 = 0"), "label", "embedding", "vec_id").select(F.col("label").alias("query_id"), "label", F.col("mean").alias("q"))
    old = vectors.where("vec_id % 2 = 1").select("vec_id", "label", F.col("embedding").alias("v"))
    return match.nearest_in_group(asked, old, "label", 5).select("label", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query("""SELECT DISTINCT sha1(text) AS cache_key FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("cache_key"))
    return keyed.where("doc_id % 3 <> 0").join(keyed.where("doc_id % 3 = 0").select("cache_key"), "cache_key", "left_anti").select("cache_key").distinct()


@query("""SELECT c_custkey, c_name, coalesce(status, 'not_processed') AS status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def log_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "orders").where("o_totalprice > 450000").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"))
    return load(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("status", F.lit("not_processed")).alias("status"))


@query("""WITH l AS (SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT source, count(*) AS n_lines, count_if(regexp_matches(line, '[0-9]')) AS with_number, count_if(trim(line) = '') AS blank, sum(length(line))::BIGINT AS chars FROM l GROUP BY source""")
def diagnostic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.lines(load(spark, sf_dir, "documents").withColumn("id", F.struct("source", "doc_id")), "id", "text").select("id.source", "line")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").rlike("[0-9]")).alias("with_number"), F.count_if(F.trim("line") == "").alias("blank"), F.sum(F.length("line").cast("long")).alias("chars")
    )


PAGE_LINES = [(1, "Intro"), (2, "El_Mod 35.16.0;1"), (2, "alpha"), (3, "beta"), (4, "El_Mod35.16.0 ; 1"), (5, "Other_Fn 1.2;3"), (6, "El_Mod 35.16.0;1"), (6, "Other_Fn 1.2;3")]


@query("""SELECT block::BIGINT AS block, name, version, first_page::INTEGER AS first_page, last_page::INTEGER AS last_page, text FROM (VALUES
(1, 'el_mod', '35.16.0;1', 2, 4, 'El_Mod 35.16.0;1' || chr(10) || 'alpha' || chr(10) || 'beta' || chr(10) || 'El_Mod35.16.0 ; 1'), (2, 'other_fn', '1.2;3', 5, 5, 'Other_Fn 1.2;3'),
(3, 'el_mod', '35.16.0;1', 6, 6, 'El_Mod 35.16.0;1' || chr(10) || 'Other_Fn 1.2;3')) v(block, name, version, first_page, last_page, text)""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, page, n, line) for n, (page, line) in enumerate(PAGE_LINES)]
    return pages.function_blocks(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")).drop("doc_id")


TABLE_LINES = ["Table 7 of Mod_facGain_T", "X 1 2", "3", "VAL 5 6 7", "Table 8", "nothing here", "Table 9", "Mod_facMap_M", "X: 0 10", "Y: 1", "VAL 4", "-5"]


@query("""SELECT table_id, label, x, y, val FROM (VALUES ('7', 'Mod_facGain_T', '1.0,2.0,3.0', '', '5.0,6.0,7.0'), ('9', 'Mod_facMap_M', '0.0,10.0', '1.0', '4.0,-5.0')) v(table_id, label, x, y, val)""")
def value_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, n, line) for n, line in enumerate(TABLE_LINES)]
    found = pages.value_tables(spark.createDataFrame(rows, "doc_id long, line_no int, line string"))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return found.select("table_id", "label", joined("x"), joined("y"), joined("val"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, list(greatest(1, length(text) // 4) ORDER BY turn) AS cost, list(turn ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
p AS (SELECT conv_id, t, len(t) AS n, list_transform(range(len(cost) + 1), lambda i: coalesce(list_sum(cost[1:i]), 0)) AS upto FROM c),
w(conv_id, chunk, a, e) AS (SELECT conv_id, 0, 1, greatest(1, len(list_filter(upto, lambda x: x <= 200)) - 1) FROM p
  UNION ALL SELECT conv_id, chunk + 1, f, greatest(f, len(list_filter(upto, lambda x: x <= upto[f] + 200)) - 1) FROM (SELECT w.conv_id, chunk, greatest(a + 1, e) AS f, upto FROM w JOIN p USING (conv_id) WHERE e < n) u)
SELECT conv_id AS block_id, chunk::INTEGER AS chunk, t[a]::INTEGER AS first_line, t[e]::INTEGER AS last_line FROM w JOIN p USING (conv_id)""")
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in chunks of 200 tokens, each next one beginning with the last turn of the one before."""
    turns_ = load(spark, sf_dir, "conversations").where("text is not null")
    return pages.budget_chunks(turns_.select(F.col("conv_id").alias("block_id"), F.col("turn").cast("int").alias("line_no"), F.col("text").alias("line")), 200, 1)


@query("""SELECT * FROM (VALUES ('Main.a2l', 'main.HEX', 'stem'), ('one.a2l', 'uno.hex', 'place'), ('two.a2l', 'zwei.hex', 'place')) v(left_name, right_name, how)""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    return pages.paired_files(frame("two.a2l", "Main.a2l", "one.a2l"), frame("zwei.hex", "uno.hex", "main.HEX"))


@query("""SELECT * FROM (VALUES ('A_C', 'updated', '5'), ('Arr_CA', 'updated', '1,2,2'), ('B_C', 'unchanged', 'off'), ('E_C', 'no_value', ''), ('Gone_C', 'missing', NULL)) v(label, status, new_vals)""")
def apply_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "A_C", "(all) 5"), (1, "A_C", "9"), (2, "Arr_CA", "1;2"), (3, "B_C", "off"), (4, "E_C", None), (5, "Gone_C", "1")]
    destination = cdfx.instances(spark.createDataFrame([("f", samples.DESTINATION)], "file string, text string"))
    found = pages.applied_values(spark.createDataFrame(rows, "seq int, label string, value string"), destination)
    return found.select("label", "status", F.array_join("new_vals", ",").alias("new_vals"))


@query("""SELECT * FROM (VALUES ('one', '2.0', false), ('two', '4.5', true), ('three', NULL, true)) v(label, vals, was_empty)""")
def backfill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.createDataFrame([(1, "one", [2.0]), (1, "two", None), (1, "three", None)], "doc_id long, label string, values array<double>")
    found = pages.backfilled(records, spark.createDataFrame([(1, "the one and two with Start value: 4.5 [V]")], "doc_id long, text string"))
    return found.select("label", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("vals"), "was_empty")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS line_no FROM documents),
m AS (SELECT *, length(line) BETWEEN 1 AND 20 AS opens, regexp_matches(line, '(?i)license|rights reserved|copyright') AS closes, trim(regexp_replace(line, '\\s+', ' ', 'g')) = '' AS skips FROM l),
s AS (SELECT *, last_value(CASE WHEN opens THEN line_no WHEN closes THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS record FROM m),
k AS (SELECT *, nullif(regexp_extract(line, '[0-9]+(?:\\.[0-9]+)?'), '') AS v, nullif(regexp_extract(line, '[%$&#]'), '') AS u FROM s WHERE record >= 0 AND NOT (skips AND NOT opens)),
d AS (SELECT doc_id, record, line, min(line_no) AS first_no FROM k GROUP BY doc_id, record, line),
c AS (SELECT doc_id, record, md5(string_agg(line, ' | ' ORDER BY first_no)) AS context FROM d GROUP BY doc_id, record)
SELECT doc_id, record AS line_no, context, min(CASE WHEN line_no = record THEN line END) AS label, arg_min(v, line_no) FILTER (v IS NOT NULL) AS value, arg_min(u, line_no) FILTER (u IS NOT NULL) AS unit
FROM k JOIN c USING (doc_id, record) GROUP BY doc_id, record, context""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines of documents open records, licence lines close them; the lines between fill the first number and mark."""
    lines = sequence.lines(load(spark, sf_dir, "documents"), "doc_id", "text")
    line = F.col("line")
    held = pages.open_records(lines, ["doc_id"], ["line_no"], F.length(line).between(1, 20), line.rlike("(?i)license|rights reserved|copyright"), F.array_contains(noise.kinds(line), "blank"))
    own = F.col("record.line_no") == F.col("line_no")
    rows = held.select(
        F.struct("doc_id", "record.line_no").alias("record_id"), F.col("line_no").alias("seq"), F.when(own, line).alias("label"), tx.part(line, r"([0-9]+(?:\.[0-9]+)?)", 1).alias("value"),
        tx.part(line, "([%$&#])", 1).alias("unit"), line.alias("context"),
    )
    return pages.continued(rows).select("record_id.doc_id", "record_id.line_no", "label", "value", "unit", F.md5("context").alias("context"))


@query("""WITH s AS (SELECT 'n' || s_nationkey AS file, 'S' || s_suppkey || '_C' AS label, 'EUR' AS unit, 1 AS n, round(s_acctbal, 2) AS total, 0 AS n_axes FROM supplier),
c AS (SELECT 'n' || c_nationkey AS file, 'N' || c_nationkey || '_CA' AS label, 'key' AS unit, count(*) AS n, sum(c_custkey)::DOUBLE AS total, 1 AS n_axes FROM customer GROUP BY c_nationkey)
SELECT file, label, unit, n::INTEGER AS n, total, n_axes::INTEGER AS n_axes FROM s UNION ALL SELECT * FROM c""")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of JSON files, one a nation: its suppliers' balances, its customers' keys over their places."""
    found = caljson.entries(derived.json_files(spark, sf_dir))
    total = F.round(F.aggregate(F.transform("vals", lambda v: v.cast("double")), F.lit(0.0), lambda x, y: x + y), 2)
    return found.select("file", "label", "unit", F.size("vals").alias("n"), total.alias("total"), F.size("axes").alias("n_axes"))


@query("""SELECT * FROM (VALUES ('Map_M', 'numeric'), ('Enum_M', 'enum')) v(label, cells)""")
def enum_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps by whether their cells are texts, numbers or both."""
    rows = cdfx.instances(spark.createDataFrame([("f", samples.DESTINATION)], "file string, text string")).where("kind = 'MAP'")
    texts = F.exists("rows", lambda r: r["is_text"])
    return rows.select("label", F.when(texts & F.exists("rows", lambda r: ~r["is_text"]), "mixed").when(texts, "enum").otherwise("numeric").alias("cells"))


ENRICHED = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS line_no FROM documents),
r AS (SELECT doc_id, line_no AS record_id, line AS context FROM l WHERE length(line) BETWEEN 1 AND 20),
s AS (SELECT DISTINCT * FROM (SELECT doc_id, record_id, record_id + 1 AS a, record_id + 2 AS b FROM r UNION ALL SELECT doc_id, record_id, 0, 1 FROM r)),
t AS (SELECT s.doc_id, record_id, a, b, trim(string_agg(rtrim(line, ' '), chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM s JOIN l ON l.doc_id = s.doc_id AND line_no BETWEEN a AND b GROUP BY s.doc_id, record_id, a, b),
u AS (SELECT doc_id, record_id, text, min((a, b)) AS first_at FROM t WHERE text <> '' GROUP BY doc_id, record_id, text),
f AS (SELECT r.doc_id, r.record_id, r.context, string_agg(text, chr(10) ORDER BY first_at) FILTER (NOT contains(r.context, text)) AS more FROM r LEFT JOIN u USING (doc_id, record_id) GROUP BY r.doc_id, r.record_id, r.context)
SELECT doc_id, record_id, md5(CASE WHEN more IS NULL THEN context ELSE concat_ws(chr(10), nullif(rtrim(context, ' '), ''), more) END) AS context FROM f"""


@query(ENRICHED)
def enriched_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines of documents with the two lines after them and the first two of their document."""
    lines = sequence.lines(load(spark, sf_dir, "documents"), "doc_id", "text")
    records = lines.where(F.length("line").between(1, 20)).select("doc_id", F.col("line_no").alias("record_id"), F.col("line").alias("context"))
    after = records.select("doc_id", "record_id", (F.col("record_id") + 1).alias("first_line"), (F.col("record_id") + 2).alias("last_line"))
    head = records.select("doc_id", "record_id", F.lit(0).alias("first_line"), F.lit(1).alias("last_line"))
    return linked.enriched(records, after.unionByName(head), lines).withColumn("context", F.md5("context"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS line_no FROM documents),
m AS (SELECT *, nullif(regexp_extract(line, '[0-9]{4,}'), '') AS mark FROM l)
SELECT doc_id, line_no, first_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS nearby FROM m""")
def marks_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long number from three lines above each line to one below."""
    lines = sequence.lines(load(spark, sf_dir, "documents"), "doc_id", "text")
    return linked.marks_nearby(lines, ["doc_id"], ["line_no"], tx.part(F.col("line"), "([0-9]{4,})", 1), "nearby").select("doc_id", "line_no", "nearby")


def turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """A role's turns as labels of their conversation: what a matching takes for rows of a workbook."""
    rows = load(spark, sf_dir, "conversations").where((F.col("role") == role) & F.col("text").isNotNull())
    none = [F.lit("").alias(c) for c in ("description", "value", "value_type", "suffix", "pages")]
    return rows.select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("function"), F.concat(F.lit("t"), "turn").alias("label"), *none, F.col("text").alias("context"))


@query()
def match_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many user turns of each conversation meet an assistant turn, and how alike they are: a frame of the match workbook."""
    sides = [turns(spark, sf_dir, "user"), turns(spark, sf_dir, "assistant")]
    asked = [d.select("function", F.col("id").alias(key), F.col("context").alias("text")) for d, key in zip(sides, ("left_id", "right_id"), strict=True)]
    pairs = similar.one_to_one(*[d.withColumn(k, F.col(k)["turn"]) for d, k in zip(asked, ("left_id", "right_id"), strict=True)], "function", 10.0)
    whole = pairs.select(*[F.struct(F.col("function").cast("long").alias("conv_id"), F.col(k).alias("turn")).alias(k) for k in ("left_id", "right_id")], "score")
    return frames.match_frames(*sides, whole, 10.0)["Function Breakdown"].toDF("function", "matches", "average")


@query("""WITH r AS (SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id), e AS (SELECT vec_id, label, role, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings JOIN r ON vec_id = conv_id),
s AS (SELECT q.vec_id AS query_id, q.label, c.vec_id, 1 - list_cosine_similarity(q.v, c.v) AS d FROM e q JOIN e c ON q.label = c.label AND q.role = 'user' AND c.role = 'assistant')
SELECT query_id, label, vec_id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) t WHERE rank <= 3""")
def opposite_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of conversations that a user ends ask those of the same label that the assistant ends."""
    ends = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))
    vectors = load(spark, sf_dir, "embeddings").join(ends, F.col("vec_id") == F.col("conv_id")).select("vec_id", "label", F.col("embedding").alias("v"), "role")
    found = match.nearest_in_tiles(vectors, F.col("role") == "user", 3, among=F.col("role") == "assistant", within=True)
    return found.select("query_id", "label", "vec_id", F.round("distance", 6).alias("distance"), "rank")
