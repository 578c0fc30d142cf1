"""Format, extraction and update queries over small written inputs; their SQL holds rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare, numeric, text
from ..operators import decode, extract, update
from ..sources import a2l, caljson, cdfx, hexfile
from . import derived, samples
from .registry import load, query


def one(spark: SparkSession, body: str, name: str = "f") -> DataFrame:
    return spark.createDataFrame([(name, body)], "file string, text string")


@query("""SELECT label, kind, value, error FROM (VALUES ('K_arr_CA', 'VAL_BLK', '5.0,-2.0,300.0', NULL), ('K_crv_T', 'CURVE', '100.0,150.0,200.0', NULL), ('K_flt_C', 'VALUE', '1.5', NULL),
('K_gap_C', 'VALUE', NULL, 'missing_bytes'), ('K_lin_C', 'VALUE', '20.0', NULL), ('K_map_M', 'MAP', '1.0,2.0,3.0,4.0,5.0,6.0', NULL), ('K_non_C', 'VALUE', NULL, 'no_record_layout'),
('K_odd_C', 'VALUE', 'other', NULL), ('K_on_C', 'VALUE', 'on', NULL), ('K_rat_C', 'VALUE', '13.0', NULL)) v(label, kind, value, error)""")
def decode_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode.decoded(one(spark, samples.DESCRIPTOR), one(spark, samples.image()))
    value = F.array_join(F.transform("value", lambda v: F.coalesce(v["txt"], v["num"].cast("string"))), ",")
    return found.select("label", "kind", value.alias("value"), "error")


@query("""SELECT * FROM (VALUES ('K_arr_CA', 'FnOne', '1.2'), ('K_lin_C', 'FnTwo', '3'), ('K_map_M', 'FnTwo', '3')) v(label, function, version)""")
def function_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a2l.functions(one(spark, samples.DESCRIPTOR)).drop("file")


@query("""SELECT place::BIGINT AS place, line FROM (VALUES (0, ':020000040000FA'), (4096, ':0A1000003D0A01070500FEFF2C0168'), (4112, ':0A10100000051400010203040506A8'), (4128, ':06102000140028003C0052'),
(65536, ':020000040001F9'), (69632, ':041000000000C03FED')) v(place, line)""")
def patch_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image written back with K_lin_C at 20.5; all that is not patched stays byte by byte."""
    value = F.array(F.struct(F.lit(20.5).alias("num"), F.lit(None).cast("string").alias("txt")))
    change = one(spark, "", "f").select("file", F.lit("K_lin_C").alias("label"), F.lit(1).alias("seq"), value.alias("value"))
    image = hexfile.written(hexfile.records(one(spark, samples.image())), decode.patches(change, one(spark, samples.DESCRIPTOR)))
    return image.select(F.col("at").alias("place"), "line")


def changes(spark: SparkSession) -> DataFrame:
    """New values of a float, a curve with its shared axis, a map with short rows, and labels that can't be written."""
    c = lambda *v: [(float(x), None) for x in v]
    rows = [
        ("K_flt_C", 1, c(-0.25), None), ("K_crv_T", 2, c(200, 100, 0), [c(0, 10, 20, 30)]), ("K_map_M", 3, [*c(9), (None, ""), *c(8, 7, 6.5, 300)], None),
        ("K_non_C", 4, c(1), None), ("ax", 5, c(1), None), ("K_new_C", 6, c(1), None), ("K_lin_C", 7, [], None),
    ]
    cell = "struct<num: double, txt: string>"
    return spark.createDataFrame([("f", *r) for r in rows], f"file string, label string, seq int, value array<{cell}>, new_axes array<array<{cell}>>")


@query("""SELECT place::BIGINT AS place, line FROM (VALUES (0, ':020000040000FA'), (4096, ':0A1000003C0A01070500FEFF2C0169'), (4112, ':0A1010000A0000000900080706FFAF'), (4128, ':06102000140028003C0052'),
(65536, ':020000040001F9'), (69632, ':04100000000080BEAE')) v(place, line)""")
def patch_floats_and_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats, a table's nearest entries, missing cells as 0, values held to their range, and an axis of three points."""
    texts = one(spark, samples.DESCRIPTOR)
    bytes_ = decode.patches(changes(spark), texts).unionByName(decode.axis_patches(changes(spark), texts))
    return hexfile.written(hexfile.records(one(spark, samples.image())), bytes_).select(F.col("at").alias("place"), "line")


@query("""SELECT label, kind, action, reason FROM (VALUES ('K_flt_C', 'patched', 'patched', 'patched from CDFX'), ('K_crv_T', 'patched', 'patched', 'patched from CDFX'), ('K_map_M', 'patched', 'patched', 'patched from CDFX'),
('K_non_C', 'no_layout', 'skipped', 'missing record layout'), ('ax', 'axis_points', 'skipped', 'no A2L characteristic (label exists as AXIS_PTS)'),
('K_new_C', 'unknown', 'skipped', 'no A2L characteristic (label not found in A2L)')) v(label, kind, action, reason)""")
def patch_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.patch_events(changes(spark), one(spark, samples.DESCRIPTOR)).select("label", "kind", "action", "reason")


PARAMETERS = """WITH i AS (SELECT 'n' || s_nationkey AS file, 0 AS late, s_suppkey AS k, 'S' || s_suppkey || '_C' AS label, 'SCALAR' AS kind, 1 AS n, round(s_acctbal, 2) AS total FROM supplier
UNION ALL SELECT 'n' || c_nationkey, 1, c_nationkey, 'N' || c_nationkey || '_CA', 'ARRAY', count(*), sum(c_custkey)::DOUBLE FROM customer GROUP BY c_nationkey)"""


@query(PARAMETERS + """ SELECT file, label, kind, n::INTEGER AS n, (row_number() OVER (PARTITION BY file ORDER BY late, k) - 1)::INTEGER AS pos, total FROM i""")
def parameter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances of parameter-set files, one a nation: its suppliers' balances as scalars, its customers' keys as an array."""
    rows = cdfx.valued(cdfx.instances(derived.parameter_files(spark, sf_dir)))
    total = F.round(F.aggregate(F.transform("vals", lambda v: v.cast("double")), F.lit(0.0), lambda x, y: x + y), 2)
    return rows.select("file", "label", "kind", F.size("vals").alias("n"), "pos", total.alias("total"))


@query(PARAMETERS + """, d AS (SELECT file, label, total FROM i WHERE kind = 'SCALAR'), u AS (SELECT file, label, k, total, CASE WHEN k % 3 = 0 THEN 'one' WHEN k % 3 = 1 THEN 'two' END AS source FROM i WHERE kind = 'SCALAR')
SELECT label, source, CASE WHEN source IS NULL THEN 'attention' WHEN source = 'one' AND total <> 0 THEN 'updated' ELSE 'copied' END AS status, CASE WHEN source = 'one' AND total <> 0 THEN round(total * 2, 2) END AS new_value FROM u""")
def update_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of files that Spark writes from suppliers, updated from two sources: doubled in the first, the same in the second, absent else."""
    return derived.updated_balances(spark, sf_dir)


def updates(spark: SparkSession) -> DataFrame:
    read = lambda body: cdfx.instances(one(spark, body))
    return update.updated([("one", read(samples.SOURCE_ONE)), ("two", read(samples.SOURCE_TWO))], read(samples.DESTINATION))


@query("""SELECT * FROM (VALUES ('A_C', 'one', 'copied', NULL), ('B_C', 'one', 'updated', 'on'), ('Arr_CA', 'one', 'updated', '0.0,5.0,10.0'), ('Crv_T', 'one', 'updated', '0.0,15.0,20.0,100.0'),
('Map_M', 'one', 'updated', '1.0,1.5,2.0,2.5,3.0,3.5'), ('Enum_M', 'one', 'skipped', NULL), ('D_C', 'two', 'updated', '6'), ('E_C', NULL, 'attention', NULL), ('F_X', NULL, 'attention', NULL)) v(label, source, status, new_values)""")
def update_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_text = lambda a: F.transform(a, lambda v: v.cast("string"))
    flat = F.coalesce(as_text(F.col("numbers")), F.col("texts"), as_text(F.flatten("cells")))
    return updates(spark).select("label", "source", "status", F.when(F.col("status") == "updated", F.array_join(flat, ",")).alias("new_values"))


@query(PARAMETERS + """ SELECT file, label, n::INTEGER AS n, CASE WHEN kind = 'SCALAR' AND k % 3 = 0 THEN round(total * 2, 2) ELSE total END AS total FROM i""")
def merged_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that Spark writes from suppliers and customers, written again with every third supplier's balance doubled, and read."""
    rows = cdfx.instances(cdfx.merged(derived.parameter_files(spark, sf_dir), derived.updates(spark, sf_dir).where("fragment is not null")))
    total = F.round(F.aggregate(F.transform("vals", lambda v: v.cast("double")), F.lit(0.0), lambda x, y: x + y), 2)
    return rows.select("file", "label", F.size("vals").alias("n"), total.alias("total"))


GOLDEN = """SELECT * FROM (VALUES ('index_resample', '0.0,5.0,10.0'), ('interpolate', '0.0,15.0,20.0,100.0'), ('interpolate_empty', '0.0,0.0'), ('interpolate_one', '7.0,7.0,7.0'), ('label_map', '1,1'),
('nearest_down', '0,3'), ('nearest_up', '0,0,1'), ('repair', '1.0:6.0,2.0:5.0'), ('pack', '2,255,0'), ('fit_all', '5,5,5'), ('fit_pad', '1,2,2,2'), ('fit_cut', '1,2'), ('direction', 'increasing')) v(name, result)"""


@query(GOLDEN)
def numeric_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    s = lambda *v: F.array(*[F.lit(x) for x in v])
    joined = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    curve = numeric.repaired(d(0, 1, 2), d(10, 20, 40))
    empty, single = numeric.repaired(d(), d()), numeric.repaired(d(3), d(7))
    fit = lambda t, n: F.array_join(text.fitted(text.explicit_values(F.lit(t)), F.lit(n)), ",")
    rules = {
        "index_resample": joined(numeric.resampled(d(0, 10), F.lit(3))),
        "interpolate": joined(numeric.interpolated(curve, d(-1, 0.5, 1, 5))),
        "interpolate_empty": joined(numeric.interpolated(empty, d(1, 2))),
        "interpolate_one": joined(numeric.interpolated(single, d(1, 2, 3))),
        "label_map": joined(numeric.label_indices(s("a", "b"), s("b", "z"))),
        "nearest_down": joined(numeric.nearest_indices(F.lit(4), F.lit(2))),
        "nearest_up": joined(numeric.nearest_indices(F.lit(2), F.lit(3))),
        "repair": F.array_join(F.transform(numeric.repaired(d(2, 1, 1), d(5, 6, 7)), lambda p: F.concat_ws(":", p["x"].cast("string"), p["v"].cast("string"))), ","),
        "pack": F.concat_ws(",", *[numeric.packed(v, "UBYTE").cast("string") for v in (F.lit(2.5), F.lit(300.0), F.lit(None).cast("double"))]),
        "fit_all": fit("(all) 5", 3),
        "fit_pad": fit("1,2", 4),
        "fit_cut": fit("1 2 3", 2),
        "direction": numeric.direction(d(1, 1, 3)),
    }
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("result")) for k, v in rules.items()])))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 5 IN (0, 1, 4) AS same FROM lineitem""")
def text_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as texts: with more places, with blanks, a hundredth larger, with a type's letter; and two absent ones."""
    price = lambda places, times=1.0: F.format_string(f"%.{places}f", F.col("l_extendedprice") * times)
    k = F.col("l_linenumber") % 5
    a = F.when(k == 4, F.lit(None)).otherwise(price(2))
    b = F.when(k == 0, price(6, 1.000001)).when(k == 1, F.concat(F.lit(" "), price(2), F.lit(" "))).when(k == 2, price(2, 1.01)).when(k == 3, F.concat(price(2), F.lit("d")))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", compare.texts_equal(a, b).alias("same"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS k, round(l_quantity, 2) AS q, round(l_extendedprice, 2) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN q END AS lower, CASE WHEN k = 0 THEN p END AS upper, CASE WHEN k = 0 THEN 'explicit_between' END AS kind,
CASE k WHEN 1 THEN [q, p] WHEN 3 THEN [q] END AS vals, CASE k WHEN 1 THEN 'EUR' WHEN 3 THEN '%' END AS unit, CASE WHEN k = 2 THEN 'X n_eng rpm 2' ELSE '' END AS axes, CASE WHEN k = 2 THEN p END AS last_point,
CASE WHEN k = 3 THEN 0.0::DOUBLE END AS range_low, CASE WHEN k = 3 THEN q END AS range_high FROM t""")
def value_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, values, axes and ranges read back out of sentences that are written about order lines."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.2f", "l_quantity").alias("q"), F.format_string("%.2f", "l_extendedprice").alias("p"))
    said = [("valid between ", "q", " and ", "p", "."), ("Start value: ", "q", ", ", "p", " [EUR]"), ("on X: n_eng [rpm] [2] ", "q", "; ", "p", ""), ("range 0...", "q", " [%]", "", "")]
    written = [F.concat(*[F.col(x) if x in ("q", "p") else F.lit(x) for x in parts]) for parts in said]
    t = F.element_at(F.array(*written), (F.col("l_linenumber") % 4 + 1).cast("int"))
    parsed = rows.select("l_orderkey", "l_linenumber", text.phrases(t).alias("f")).select("l_orderkey", "l_linenumber", *[F.col(f"f.{name}").alias(name[0]) for name in ("limits", "start_value", "axes", "physical_range")])
    axis = lambda e: F.concat_ws(" ", e["axis"], e["signal"], e["unit"], e["size"].cast("string"))
    return parsed.select(
        "l_orderkey", "l_linenumber", "l.lower", "l.upper", "l.kind", F.col("s.values").alias("vals"), "s.unit", F.array_join(F.transform("a", axis), ";").alias("axes"),
        F.try_element_at(F.get("a", F.lit(0))["breakpoints"], F.lit(-1)).alias("last_point"), F.col("p.lower").alias("range_low"), F.col("p.upper").alias("range_high"),
    )


@query("""WITH n AS (SELECT p_partkey, replace(p_brand, '#', '') AS module, CASE WHEN p_size % 2 = 0 THEN 'inst' || p_size END AS instance, ['ti', 'fac', NULL][p_size % 3 + 1] AS prefix, 'X' || p_type AS name, ['C', 'T', 'M', 'CA', 'Q'][p_partkey % 5 + 1] AS suffix FROM part)
SELECT p_partkey, CASE WHEN suffix <> 'Q' THEN module END AS module, CASE WHEN suffix <> 'Q' THEN instance END AS instance, CASE WHEN suffix <> 'Q' THEN prefix END AS prefix, CASE WHEN suffix <> 'Q' THEN name END AS name,
CASE WHEN suffix <> 'Q' THEN suffix END AS suffix, CASE suffix WHEN 'C' THEN 'VALUE' WHEN 'T' THEN 'CURVE' WHEN 'M' THEN 'MAP' WHEN 'CA' THEN 'VAL_BLK' END AS object_class FROM n""")
def label_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are made of parts' brands, sizes and types, taken apart again."""
    size, pick = F.col("p_size"), lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    label = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_"), F.when(size % 2 == 0, F.concat(F.lit("inst"), size, F.lit("."))).otherwise(""), pick(size, "ti", "fac", ""), F.lit("X"), F.col("p_type"), F.lit("_"), pick(F.col("p_partkey"), "C", "T", "M", "CA", "Q"))
    return load(spark, sf_dir, "part").select("p_partkey", text.label_parts(label).alias("e")).select("p_partkey", "e.*")


RECORD_LINES = [
    (1, "IF (a i(Alpha) and i (Beta))"), (1, "Fn_Val_C first words"), (1, "more words"), (1, "Start Value : 12.5 [V]"),
    (1, "IF (i(Gamma))"), (1, "Fn_Long-"), (1, "Name_C wrapped"), (2, "Standard Value: 3"),
    (2, "IF (i(Delta))"), (2, "Fn_Lost_C"), (5, "Start Value : 9"), (5, "IF (i(Eps))"), (5, "plain words"), (5, "Start Value: 1"), (5, "IF (i(Z))"), (5, "Fn_One_C Start Value : 7 [ - ]"),
]


@query("""SELECT label, start_value, unit, condition, description, page::INTEGER AS page, reconstructed FROM (VALUES ('Fn_Val_C', '12.5', 'V', 'Alpha || Beta', 'first words more words', 1, false),
('Fn_LongName_C', '3', '', 'Gamma', 'wrapped', 2, true), ('Fn_One_C', '7', '-', 'Z', '', 5, false)) v(label, start_value, unit, condition, description, page, reconstructed)""")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, page, n, line) for n, (page, line) in enumerate(RECORD_LINES)]
    return extract.records(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")).drop("doc_id")


@query("""SELECT label, anchor_line::INTEGER AS anchor_line, chunk_index::INTEGER AS chunk_index, text FROM (VALUES ('A_C', 1, 0, 'zero' || chr(10) || 'one A_C' || chr(10) || 'two'),
('B_C', 3, 0, 'two' || chr(10) || 'three B_C A_C' || chr(10) || 'four'), ('A_C', 3, 1, 'two' || chr(10) || 'three B_C A_C' || chr(10) || 'four')) v(label, anchor_line, chunk_index, text)""")
def label_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, n, line) for n, line in enumerate(["zero", "one A_C", "two", "three B_C A_C", "four", "five"])]
    return extract.chunks(spark.createDataFrame(rows, "block_id long, line_no int, line string"), r"\b([A-Z]_C)\b", 1, 1).drop("block_id")


@query("""SELECT label, anchor_line::INTEGER AS anchor_line, text FROM (VALUES ('A_C', 2, 'bbbb' || chr(10) || 'x A_C' || chr(10) || 'cccc'), ('B_C', 7, 'B_C')) v(label, anchor_line, text)""")
def budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tokens: one line each way; a boundary on both sides leaves the line alone."""
    rows = [(1, n, line) for n, line in enumerate(["aaaa", "bbbb", "x A_C", "cccc", "dddd", "eeee", "== head", "B_C", "== end"])]
    return extract.chunks(spark.createDataFrame(rows, "block_id long, line_no int, line string"), r"\b([A-Z]_C)\b", 12, 40, 3, "^==").drop("block_id", "chunk_index")


@query("""SELECT * FROM (VALUES ('A_C', 'updated', '33.3'), ('B_C', 'updated', 'on'), ('Map_M', 'updated', '1.0,1.5,2.0,2.5,3.0,3.5'), ('Arr_CA', 'copied', NULL), ('Crv_T', 'attention', NULL), ('Enum_M', 'attention', NULL),
('D_C', 'attention', NULL), ('E_C', 'attention', NULL), ('F_X', 'attention', NULL)) v(label, status, new_values)""")
def update_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON source, compared as exact text."""
    body = '{"A_C": {"value": "33.3"}, "B_C": {"value": "on"}, "Arr_CA": {"value": ["x", 7, 7]}, "Map_M": {"value": [[1, 2], [3, 4]], "axes": [[0, 10], [0, 10]]}}'
    target = samples.DESTINATION.replace("<V>7</V><V>7</V><V>7</V>", "<VT>x</VT><VT>7</VT><VT>7</VT>")
    found = update.updated([("json", caljson.instances(one(spark, body)))], cdfx.instances(one(spark, target)), exact=True)
    as_text = lambda a: F.transform(a, lambda v: v.cast("string"))
    flat = F.coalesce(as_text(F.col("numbers")), F.col("texts"), as_text(F.flatten("cells")))
    return found.select("label", "status", F.when(F.col("status") == "updated", F.array_join(flat, ",")).alias("new_values"))


@query("""WITH e AS (SELECT vec_id, label, vec_id % 3 AS k, list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings), i AS (SELECT *, unnest(range(4))::INTEGER AS index FROM e)
SELECT vec_id, CASE WHEN k < 2 THEN 's' || label END AS signal, CASE WHEN k < 2 THEN 'rpm' END AS unit, index, CASE WHEN k = 0 THEN index * 10.0::DOUBLE END AS x, CASE WHEN k = 1 THEN v[1] ELSE v[index + 1] END AS value FROM i WHERE k < 2 OR index < 2""")
def unpivot_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as curves: over breakpoints, a single value over an axis that tells its size alone, values without axis."""
    k, none = F.col("vec_id") % 3, F.lit(None).cast("array<double>")
    cut = F.transform(F.slice("embedding", 1, 4), lambda v: numeric.rounded(v.cast("double"), 6))
    head = F.struct(F.lit("X").alias("axis"), F.concat(F.lit("s"), "label").alias("signal"), F.lit("rpm").alias("unit"), F.lit(4).alias("size"), F.when(k == 0, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i * F.lit(10.0))).otherwise(none).alias("breakpoints"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.when(k == 0, cut).when(k == 1, F.slice(cut, 1, 1)).otherwise(F.slice(cut, 1, 2)).alias("vals"), F.when(k < 2, F.array(head)).alias("axes"))
    return extract.unpivoted_curves(rows, ["vec_id"], "vals", "axes")
