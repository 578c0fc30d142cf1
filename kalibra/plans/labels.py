"""Label, sheet and page-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compare, convert, labels, numeric, text
from ..operators import extract, linked, match, reconcile
from ..sources import tabular
from .registry import load, query


@query("""SELECT * FROM (VALUES ('Eem_tiWait_C', '', 'a description that is long', true, true, 'Scalar'), ('FId_Map_M', '{1,2}', '', true, true, '2D Map'), ('Other_X_C', '5', '', true, false, 'Scalar'),
('has space_C', '5', '', false, false, 'Scalar'), ('Eem_x', '1;2', '', false, false, 'Array'), ('Eem_cur_T', '1 -> 2', '', true, true, 'Curve/Table'), ('Eem_Short_C', '', 'short', true, false, 'Scalar'), ('P123_Eem_C', '5', '', true, false, 'Scalar'), ('Eem_list', '[1, 2]', '', false, false, 'Array'), ('Eem_pts', 'at 3: 4', '', false, false, 'Curve/Table')) v(label, value, description, shape, relevant, structure)""")
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Eem_tiWait_C", "", "a description that is long"), ("FId_Map_M", "{1,2}", ""), ("Other_X_C", "5", ""), ("has space_C", "5", ""), ("Eem_x", "1;2", ""), ("Eem_cur_T", "1 -> 2", ""), ("Eem_Short_C", "", "short"), ("P123_Eem_C", "5", ""), ("Eem_list", "[1, 2]", ""), ("Eem_pts", "at 3: 4", "")]
    c = F.col
    return spark.createDataFrame(rows, "label string, value string, description string").select(
        "label", "value", "description", labels.looks_like_label(c("label")).alias("shape"), labels.relevant(c("label"), F.lit("Fn"), c("description"), c("value"), ("Eem_", "FId_", "P123_")).alias("relevant"), labels.structure(c("value"), c("label")).alias("structure")
    )


@query("""SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')), 'standard value', 'value'), 'start value', 'value'), 'default value', 'value'), 'initial value', 'value'), 'shall', 'must')) AS norm FROM conversations WHERE text IS NOT NULL""")
def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.md5(labels.semantic(F.col("text"))).alias("norm"))


@query("""SELECT * FROM (VALUES ('a', '1', ''), ('b', '', '')) v(label, value, unit)""")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", "1", "x"), ("b", None, "y")], "`Label Name` string, `START_VALUE` string, other string")
    return tabular.canonical(rows, {"label": ["label name"], "value": ["start value", "value"], "unit": ["units"]}, ["label"])


@query("""SELECT label, function, seq::INTEGER AS seq FROM (VALUES ('A_C', 'FnOne', 1), ('B_C', 'FnOne', 2), ('C_C', 'FnTwo', 6), ('D_C', 'FnTwo', 7)) v(label, function, seq)""")
def grouped_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "*** FnOne ***", ""), (1, "A_C", "FnOne"), (2, "B_C", ""), (3, "A_C", ""), (4, "", ""), (5, "*** FnTwo ***", ""), (6, "C_C", "FnTwo"), (7, "D_C", "NOT FOUND")]
    return tabular.grouped(spark.createDataFrame(rows, "seq int, label string, function string"), "label", "function", "seq")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 0.0::DOUBLE FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return tabular.upserted(orders, orders.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.where_all(load(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"}).select("o_orderkey")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), hit AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '[#*]{3}')),
x AS (SELECT DISTINCT p FROM (SELECT unnest(range(doc_id - 1, doc_id + 2)) AS p FROM hit) t) SELECT p AS page FROM x, n WHERE p >= 0 AND p < n""")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a marker, and one before and after each, within the document."""
    documents = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").rlike(r"[#*]{3}"), F.lit(False)).alias("hit"))
    total = documents.agg(F.count(F.lit(1)).alias("n"))
    near = documents.where("hit").select(F.explode(F.sequence(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("page")).distinct()
    return near.join(F.broadcast(total), (F.col("page") >= 0) & (F.col("page") < F.col("n"))).select("page")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::INTEGER AS i FROM documents),
h AS (SELECT *, CASE WHEN length(line) < 20 THEN i END AS head FROM l)
SELECT doc_id, i AS line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading,
coalesce(min(head) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(i) OVER (PARTITION BY doc_id) + 1)::INTEGER AS section_end FROM h""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading above each line and the line where its section ends; short lines are headings here."""
    from ..operators import sequence

    rows = sequence.lines(load(spark, sf_dir, "documents"), "doc_id", "text")
    own, head = sequence.ordered(["doc_id"], ["line_no"]), F.when(F.length("line") < 20, F.col("line_no"))
    following = F.min(head).over(own.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("line_no").over(Window.partitionBy("doc_id")) + 1
    return rows.select("doc_id", "line_no", sequence.filled(head, ["doc_id"], ["line_no"]).alias("heading"), F.coalesce(following, last).alias("section_end"))


@query("""SELECT kind, physical, raw FROM (VALUES ('LINEAR', '20.0', '60.0'), ('RAT_FUNC', '13.0', '10.0'), ('TAB_VERB', 'on', '1.0'), ('TAB_INTP', '150.0', '0.0'), ('IDENTICAL', '7.0', '7.0'), ('TAB_NOINTP', '7.0', '7.0')) v(kind, physical, raw)""")
def conversion_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("LINEAR", 60.0, None, [0.5, -10.0], None), ("RAT_FUNC", 10.0, [0.0, 2.0, 4.0, 0.0, 3.0, 0.0], None, None), ("TAB_VERB", 1.0, None, None, [(0.0, None, "off"), (1.0, None, "on")]),
            ("TAB_INTP", 5.0, None, None, [(0.0, 100.0, "100"), (10.0, 200.0, "200")]), ("IDENTICAL", 7.0, None, None, None), ("TAB_NOINTP", 7.0, None, None, [(0.0, 5.0, "5"), (1.0, 9.5, "9.5")])]
    df = spark.createDataFrame(rows, "kind string, raw double, coeffs array<double>, linear array<double>, pairs array<struct<raw: double, num: double, txt: string>>")
    c = F.col
    given = df.select("*", convert.physical(c("raw"), c("kind"), c("coeffs"), c("linear"), c("kind"), c("pairs"), F.lit(None).cast("string")).alias("p"))
    back = convert.stored(c("p.num"), c("p.txt"), c("kind"), c("coeffs"), c("linear"), c("pairs"))
    return given.select("kind", F.coalesce("p.txt", c("p.num").cast("string")).alias("physical"), back.cast("string").alias("raw"))


@query("""WITH RECURSIVE k(event_id, v) AS (SELECT event_id, props::JSON FROM events WHERE props IS NOT NULL UNION ALL SELECT k.event_id, value FROM k, json_each(k.v) WHERE json_type(k.v) = 'OBJECT')
SELECT event_id, count(*) - 1 AS keys FROM k GROUP BY event_id""")
def json_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of each event's JSON at every depth."""
    return text.key_counts(load(spark, sf_dir, "events"), "event_id", "props").withColumnRenamed("n", "keys")


@query("""SELECT label, "values", direction FROM (VALUES ('up', '1,2,2', 'increasing'), ('down', '3,1', 'decreasing'), ('wave', '1,3,2', 'none'), ('text', 'a,b', NULL)) v(label, "values", direction)""")
def label_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("up", ["1", "2", "2"]), ("down", ["3", "1"]), ("wave", ["1", "3", "2"]), ("text", ["a", "b"])], "label string, vals array<string>")
    numbers = compare.all_numbers(F.col("vals"))
    return rows.select("label", F.array_join("vals", ",").alias("values"), F.when(numbers.isNotNull(), numeric.direction(numbers)).alias("direction"))


@query("""SELECT o_orderkey, o_orderstatus || ' | ' || o_orderpriority AS context, printf('%.2f', o_totalprice) AS shown, '[' || o_custkey || ',' || o_orderkey || ']' AS keys FROM orders""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    context = F.array_join(F.array_distinct(F.array("o_orderstatus", "o_orderpriority")), " | ")
    return orders.select("o_orderkey", context.alias("context"), F.format_string("%.2f", F.col("o_totalprice")).alias("shown"), F.to_json(F.array("o_custkey", "o_orderkey")).alias("keys"))


@query("""SELECT * FROM (VALUES ('fenced', 2), ('none', NULL), ('talk', 1)) v(name, n)""")
def salvaged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("fenced", '```json\n[{"a": 1}, {"a": 2}]\n```'), ("none", "no list"), ("talk", 'here: [{"a": 5}] done')], "name string, t string")
    found = text.salvaged_array(F.col("t"), "array<struct<a: int>>")
    return rows.select("name", F.when(found.isNotNull(), F.size(found)).alias("n"))


@query("""SELECT a, b, score::DOUBLE AS score FROM (VALUES ('', '', 100.0), ('abcd', 'bcde', 75.0), ('Same  text', 'same text', 100.0), ('x', '', 0.0)) v(a, b, score)""")
def similarity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("", ""), ("abcd", "bcde"), ("Same  text", "same text"), ("x", "")], "a string, b string")
    return rows.select("a", "b", match.text_similarity("a", "b").alias("score"))


@query("""SELECT label, object_class, context, vals, unit, lower::DOUBLE AS lower, upper::DOUBLE AS upper, limit_kind, n_axes::INTEGER AS n_axes, table_ref FROM (VALUES
('Mod_tiWait_C', 'VALUE', 'waits between 1 and 9', '5.0', 's', 1, 9, 'explicit_between', 0, NULL), ('Mod_facGain_C', 'VALUE', 'gain', '0.5', 'dimensionless', 0, 1, 'implicit_factor', 0, NULL),
('Mod_bOn_C', 'VALUE', 'switch', '1.0', NULL, 0, 1, 'implicit_boolean', 0, NULL), ('Mod_tiMap_T', 'CURVE', 'X: n [rpm] [2] 1 2', NULL, NULL, 0, NULL, 'implicit_non_negative', 1, '12'),
('Mod_uBat_C', 'VALUE', 'battery', '12.0', 'V', NULL, NULL, 'unbounded', 0, NULL), ('Mod_iTab_T', 'CURVE', 'as Table 3 says', NULL, NULL, NULL, NULL, 'unbounded', 0, '12'),
('Mod_uList_T', 'CURVE', 'Y: 1 2 3 [rpm] 5 [V]', '5.0', 'V', NULL, NULL, 'unbounded', 0, NULL)) v(label, object_class, context, vals, unit, lower, upper, limit_kind, n_axes, table_ref)""")
def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Mod_tiWait_C", "waits between 1 and 9 Start value: 5 [s]"), ("Mod_facGain_C", "gain Default value 0.5 [-]"), ("Mod_bOn_C", "switch initial value: 1"), ("Mod_tiMap_T", "X: n [rpm] [2] 1 2 Start value: see Table 12"), ("Mod_uBat_C", "battery  start value 12 [V]"), ("Mod_iTab_T", "as Table 3 says Start value: see Table 12"), ("Mod_uList_T", "Y: 1 2 3 [rpm] 5 [V]")]
    parsed = spark.createDataFrame(rows, "label string, t string").select("label", text.calibration_row(F.col("label"), F.col("t")).alias("r"))
    return parsed.select("label", "r.object_class", "r.context", F.array_join(F.transform("r.values", lambda v: v.cast("string")), ",").alias("vals"), "r.unit", "r.lower", "r.upper", "r.limit_kind", F.size("r.axes").alias("n_axes"), "r.table_ref")


@query("""SELECT * FROM (VALUES ('E1M_x EMO1 a_c −5(cid:3)', 'ElM_x EM01 a_C -5')) v(t, repaired)""")
def scan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("E1M_x EMO1 a_c −5(cid:3)",)], "t string").select("t", text.repaired_text(F.col("t")).alias("repaired"))


@query("""SELECT vec_id, (p // 8)::INTEGER AS row, (p % 8)::INTEGER AS col, (p % 8)::DOUBLE * 10 AS x, CASE WHEN p // 8 < 4 THEN (p // 8)::DOUBLE END AS y, round(embedding[p + 1]::DOUBLE, 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings) t""")
def unpivot_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a map of eight rows, over a full and a short axis."""
    v = F.transform("embedding", lambda x: numeric.rounded(x.cast("double"), 6))
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(v, r * 8 + 1, F.lit(8)))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", cells.alias("cells"), F.expr("transform(sequence(0, 7), i -> i * 10D)").alias("xs"), F.expr("transform(sequence(0, 3), i -> cast(i AS double))").alias("ys"))
    return extract.unpivoted_maps(rows, ["vec_id"], "cells", "xs", "ys")


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS t FROM conversations),
n AS (SELECT *, regexp_extract(t, '(?i)\\b(?:start|standard|default|initial)\\s*value\\b\\s*:\\s*([^\\s\\[]+)', 1) AS marked, regexp_extract_all(t, '[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?')[1:24] AS ns FROM c),
v AS (SELECT conv_id, turn, CASE WHEN marked <> '' THEN marked WHEN len(ns) > 0 THEN array_to_string(ns, ', ') ELSE t END AS v FROM n)
SELECT conv_id, turn, md5(CASE WHEN length(v) > 120 THEN rtrim(substr(v, 1, 117)) || '...' ELSE v END) AS value FROM v""")
def primary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(labels.primary_value(F.col("text"))).alias("value"))


@query("""SELECT label, how, val::DOUBLE AS val FROM (VALUES ('A_T', 'number', 3), ('B_T', 'label', 9), ('C_T', 'label', 9), ('D_T', NULL, NULL), ('E_T', NULL, NULL)) v(label, how, val)""")
def linked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables numbered 1 the richer counts; a number without a table links nothing, whatever the context says."""
    d = lambda *v: [float(x) for x in v]
    tables = spark.createDataFrame([(1, 0, "1", "Z_T", d(1), None, d(5)), (1, 1, "1", "Y_T", d(1, 2), None, d(3, 4)), (1, 2, "2", "B_T", d(1), d(2), d(9)), (1, 3, "3", "C_T", None, None, d(9)), (1, 4, "4", "D_T", None, None, d(8)), (2, 0, "9", "E_T", None, None, d(1))],
                                   "doc_id int, seq int, table_id string, label string, x array<double>, y array<double>, val array<double>")
    records = spark.createDataFrame([(1, "A_T", "1", ""), (1, "B_T", None, "as in [ B_T ]"), (1, "C_T", None, "See  table below"), (1, "D_T", None, "plain"), (1, "E_T", "9", "see table")], "doc_id int, label string, table_ref string, context string")
    return linked.linked(records, tables).select("label", "how", F.get("val", F.lit(0)).alias("val"))


@query("""SELECT l_returnflag AS label, how, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_partkey % 7 = 0 THEN 'exact' WHEN (l_partkey % 1000)::VARCHAR LIKE '1%' THEN 'prefix' WHEN (l_partkey % 1000)::VARCHAR LIKE '%3' THEN 'suffix' ELSE 'none' END AS how FROM lineitem) t GROUP BY ALL""")
def tiers_with_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact entries first, then beginnings, then endings."""
    entry = lambda text, value: spark.createDataFrame([(text, value)], "entry string, value string")
    key = F.when(F.col("l_partkey") % 7 == 0, "whole").otherwise((F.col("l_partkey") % 1000).cast("string"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), key.alias("key"))
    found = reconcile.tiered(rows, "key", entry("whole", "exact"), entry("1", "prefix"), F.lit("none"), entry("3", "suffix"))
    return found.groupBy("label", F.col("found").alias("how")).agg(F.count(F.lit(1)).alias("n"))
