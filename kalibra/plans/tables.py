"""Queries over the rows and value tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, linked, pages, rows, sequence
from .registry import load, query

PAGE_ONE = """1.2 Fuel_Main
some talk
[apph_labtab]
Label name Description Start value
Mod_tiWait_C waits long
Start value: 5 [s]

Mod_uBat_C battery
X: n [rpm] [2] 1 2
lost line
Mod_facGain_C gain
one
two
three"""
PAGE_TWO = """goes on
Mod_iTab_T current of Mod_uBat_C
2 [Next_Fn] 1.0
Mod_numOut_C is outside"""
PAGE_THREE = """Mod_ctLoose_C loose and long Start value: 3
2025-01-01
Mod_uBat_C short"""


def sample_lines(spark: SparkSession) -> DataFrame:
    each = [(1, page, no, line) for page, body in enumerate((PAGE_ONE, PAGE_TWO, PAGE_THREE), 1) for no, line in enumerate(body.split("\n"))]
    return spark.createDataFrame(each, "doc_id int, page int, line_no int, line string")


@query("""SELECT label, page::INTEGER AS page, module, text FROM (VALUES ('Mod_tiWait_C', 1, 'Fuel_Main', 'Mod_tiWait_C waits long Start value: 5 [s]'), ('Mod_uBat_C', 1, 'Fuel_Main', 'Mod_uBat_C battery'),
('Mod_facGain_C', 1, 'Fuel_Main', 'Mod_facGain_C gain one two'), ('Mod_iTab_T', 2, 'Fuel_Main', 'Mod_iTab_T current of Mod_uBat_C')) v(label, page, module, text)""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of open tables, three lines at most; the table of page one is open on page two until the heading."""
    return rows.label_rows(sample_lines(spark), most=3).select("label", "page", "module", "text")


@query("""SELECT label, context, start_value, unit, page::INTEGER AS page, module FROM (VALUES ('Mod_tiWait_C', 'waits long Start value: 5 [s]', '5.0', 's', 1, 'Fuel_Main'), ('Mod_uBat_C', 'battery', NULL, '', 1, 'Fuel_Main'),
('Mod_facGain_C', 'gain one two three', NULL, '', 1, 'Fuel_Main'), ('Mod_iTab_T', 'current of Mod_uBat_C', NULL, '', 2, 'Fuel_Main'),
('Mod_numLoose_C', 'loose and long Start value: 3', '3.0', '', 3, 'Next_Fn')) v(label, context, start_value, unit, page, module)""")
def simple_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's longest row; a page without a table is read up to its first heading."""
    lines = sample_lines(spark).withColumn("line", F.replace("line", F.lit("ctLoose"), F.lit("numLoose")))
    found = rows.simple_calibration_rows(lines)
    return found.select("label", "context", F.array_join(F.transform("start_value", lambda v: v.cast("string")), ",").alias("start_value"), "unit", "page", "module")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count_if(regexp_matches(line, '^\\s*\\d+(\\.\\d+){0,6}\\s+\\[?\\w')) AS headings, count_if(regexp_matches(line, '^\\s*\\d+(\\.\\d+){1,6}\\s+\\S') OR (length(trim(line)) < 90 AND ends_with(trim(line), ':'))) AS sections,
count_if(regexp_matches(line, '(?i)^\\s*table\\s+\\d+(\\W|$)')) AS titles, count_if(regexp_matches(line, '(?i)^\\s*caution(\\W|$)')) AS cautions, count_if(regexp_matches(lower(line), 'calibration of function labels|must be edited by|label name|description|caution|apph_labtab')) AS noise FROM l GROUP BY doc_id""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document are headings, section heads, table titles, cautions, noise."""
    line = F.col("line")
    kinds = {"headings": rows.is_heading(line), "sections": rows.is_section(line), "titles": rows.is_title(line), "cautions": rows.is_caution(line), "noise": rows.is_noise(line)}
    lines = sequence.lines(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", *[k.alias(c) for c, k in kinds.items()])
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), *[F.count_if(c).alias(c) for c in kinds])


@query("""SELECT label, description, value, value_structure FROM (VALUES ('Eem_tiWait_C', 'waits a while until done', '5', 'Scalar'), ('Eem_facLong_C', 'a factor that is described at length', '1', 'Scalar'),
('Eem_numMany_CA', 'many of them', '1', 'Array')) v(label, description, value, value_structure)""")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked value is its first word; the richer of two rows of a label; functions and parts are none."""
    body = """Eem_tiWait_C waits
Eem_tiWait_C | waits a while
Start value: 5 [s]
Label name
until done
Eem_facLong_C a factor that is described at length initial value: 1
Eem_numMany_CA
many
of them
initial value:
1
2
3; 4
Eem_noValue_C short
P123_Eem_C value"""
    lines = spark.createDataFrame([(1, "Eem_Fn", no, line) for no, line in enumerate(body.split("\n"))], "section_id int, function string, line_no int, line string")
    moved = lines.withColumn("line", F.replace("line", F.lit("at length initial"), F.lit("at length\ninitial"))).select("section_id", "function", (F.col("line_no") * 10).alias("line_no"), F.posexplode(F.split("line", "\n")).alias("k", "line"))
    return rows.section_labels(moved.withColumn("line_no", F.col("line_no") + F.col("k")).drop("k"), ("Eem_", "P123_")).select("label", "description", "value", "value_structure")


@query("""SELECT table_key, x, y, z FROM (VALUES ('sized', '1.0,2.0', '10.0,20.0', '5.0,6.0|7.0,8.0'), ('unsized', '1.0,2.0,3.0', '10.0,20.0', '1.0,1.0,1.0|2.0,2.0,2.0'), ('cut', '1.0', '10.0', '4.0')) v(table_key, x, y, z)""")
def split_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps printed in pieces: a y point's first row counts, rows beyond the size go, text and what follows a title is left out."""
    bodies = {
        ("sized", 2, 2): ["Y/X", "1 2", "10 5 6", "note", "Y / X", "y/x", "1 2", "10 0 0", "20 7 8", "Table 9", "30 1 1"],
        ("unsized", None, 2): ["before 1", "Y/X", "1 2 3", "10 1 1 1", "20 2 2 2"],
        ("cut", 1, 1): ["Y/X", "1", "10 4", "20 5"],
        ("none", 2, 0): ["Y/X", "1 2", "10 5 6"],
    }
    each = [(*key, no, line) for key, body in bodies.items() for no, line in enumerate(body)]
    found = rows.split_maps(spark.createDataFrame(each, "table_key string, x_size int, y_size int, line_no int, line string"))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return found.select("table_key", text(F.col("x")).alias("x"), text(F.col("y")).alias("y"), F.array_join(F.transform("z", text), "|").alias("z"))


@query("""SELECT label, table_seq::INTEGER AS table_seq, how FROM (VALUES ('A_T', 1, 'number'), ('B_T', 2, 'digits'), ('C_T', 3, 'label'), ('m.Deep_T', 4, 'ending'), ('E_T', NULL, NULL), ('F_T', 5, 'label')) v(label, table_seq, how)""")
def loose_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = spark.createDataFrame([(1, 1, "7", "Z_T"), (1, 2, "T-12", "Y_T"), (1, 3, "3", "C_T"), (1, 4, "4", "Mod_xdeep_t"), (1, 5, "5", "F_T"), (1, 6, "6", "Mod_DEEP_T"), (2, 7, "99", "E_T")], "doc_id int, seq int, table_id string, label string")
    records = spark.createDataFrame([(1, "A_T", "7"), (1, "B_T", "12"), (1, "C_T", None), (1, "m.Deep_T", None), (1, "E_T", "99"), (1, "F_T", "none")], "doc_id int, label string, table_ref string")
    return linked.loosely_linked(records, tables).select("label", "table_seq", "how")


@query("""SELECT o_orderkey, o_orderpriority AS label, o_orderstatus AS limit_type, o_totalprice::DOUBLE AS limit_lower, NULL::DOUBLE AS limit_upper, '[' || o_custkey || ']' AS axes, o_orderkey AS calibration_table_id, o_custkey AS calibration_page, o_orderpriority AS parent_module FROM orders""")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    limits = F.struct(F.col("o_totalprice").cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.col("o_orderstatus").alias("type"))
    source = F.struct(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("module"))
    return frames.sheet_rows(orders.select("o_orderkey", F.col("o_orderpriority").alias("label"), limits.alias("limits"), source.alias("source"), F.array("o_custkey").alias("axes")))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS ls, text FROM documents)
SELECT doc_id FROM t WHERE regexp_matches(text, '[Tt]he') AND len(list_filter(ls[1:12], lambda x: regexp_matches(x, '^[A-Z][a-z]+ [a-z]+'))) > 0""")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a mark anywhere and a header in one of their first twelve lines that are not blank."""
    texts = load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return rows.has_header_and_table(texts, ["^[A-Z][a-z]+ [a-z]+", r"^\d+\.\d+;\d+$"], "[Tt]he").select("doc_id")


@query("""SELECT doc_id, md5(trim(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[A-Z][a-z]+ [a-z]+ ') AND NOT regexp_matches(x, '[0-9]{4}')), chr(10)), ' ' || chr(10) || chr(9) || chr(13))) AS body FROM documents""")
def stripped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that look like headers."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(rows.without_furniture(F.coalesce("text", F.lit("")), ["^[A-Z][a-z]+ [a-z]+ ", "[0-9]{4}"])).alias("body"))


def review(spark: SparkSession) -> dict[str, DataFrame]:
    d = lambda *v: [float(x) for x in v]
    tables = spark.createDataFrame([(1, 1, "1", "Crv_T", d(1, 2), None, d(3, 4)), (1, 2, "2", "Map_M", d(1, 2), d(7), d(1, 2, 3)), (1, 3, "3", "Arr_CA", None, None, d(5, 6))], "doc_id int, seq int, table_id string, label string, x array<double>, y array<double>, val array<double>")
    cases = [("Crv_T", "CURVE", "talk", None, "1"), ("Map_M", "MAP", " ", None, None), ("Arr_CA", "VAL_BLK", "list", None, None), ("One_C", "VALUE", "x", "5", None)]
    records = spark.createDataFrame([(1, "M", label, kind, context, value, "s", 0.0 if kind == "VALUE" else None, None, ref, 3) for label, kind, context, value, ref in cases],
                                    "doc_id int, module string, label string, object_class string, context string, start_value string, unit string, lower double, upper double, table_ref string, page int")
    return frames.calibration_frames(records, tables)


@query("""SELECT label, object_class, context_present, start_value_present, physical_range_present, value_table_linked, numeric_curve_values::BIGINT AS numeric_curve_values, numeric_map_values::BIGINT AS numeric_map_values, source_page::INTEGER AS source_page
FROM (VALUES ('Crv_T', 'CURVE', true, false, false, true, 2, 0, 3), ('Map_M', 'MAP', false, false, false, true, 0, 3, 3), ('Arr_CA', 'VAL_BLK', true, false, false, true, 0, 0, 3), ('One_C', 'VALUE', true, true, true, false, 0, 0, 3))
v(label, object_class, context_present, start_value_present, physical_range_present, value_table_linked, numeric_curve_values, numeric_map_values, source_page)""")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review(spark)["audit"].drop("doc_id", "module")


@query("""SELECT table_id, x_index::INTEGER AS x_index, x_value::DOUBLE AS x_value, y_index::INTEGER AS y_index, y_value::DOUBLE AS y_value, z_value::DOUBLE AS z_value FROM (VALUES ('2', 0, 1, 0, 7, 1), ('2', 1, 2, 0, 7, 2), ('2', 0, 1, 1, NULL, 3)) v(table_id, x_index, x_value, y_index, y_value, z_value)""")
def review_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review(spark)["maps"].drop("doc_id", "module", "label")


@query("""SELECT name, lines::BIGINT AS lines FROM (VALUES ('fuel_main', 2)) v(name, lines)""")
def function_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header's pages, carried on over pages without one."""
    lines = spark.createDataFrame([(1, 1, 0, "FC: Fuel_Main / 1.2;3"), (1, 2, 0, "goes on")], "doc_id int, page int, line_no int, line string")
    return pages.function_blocks(lines).select("name", (F.size(F.split("text", "\n"))).cast("long").alias("lines"))
