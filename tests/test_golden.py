"""Rows worked out by hand for small inputs whose queries run over tables."""

from pyspark.sql import functions as F

from kalibra.functions import compare, text
from kalibra.operators import extract, pages, rows
from kalibra.plans import formats, samples
from kalibra.sources import caljson, cdfx


def test_chunks_within_a_budget(spark):
    rows = [(1, 0, "a" * 8), (1, 1, "b" * 8), (1, 2, "c" * 8), (1, 3, "d" * 16), (1, 4, "e" * 4), (2, 0, "f" * 400)]
    got = pages.budget_chunks(spark.createDataFrame(rows, "block_id long, line_no int, line string"), 6, 1)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 3, 4), (2, 0, 0, 0)]


def test_entries_of_every_form(spark):
    body = '{"A_C": {"value": 1.5, "unit": "V"}, "B_CA": {"value": [1, "two", 3], "unit": ""}, "C_T": {"value": [4, 5], "unit": "K", "axes": [[0, 1]]}, "D_M": {"value": [[1, 2], [3, 4]], "unit": "K", "axes": [{"values": [0, 1]}, [7, 8]]}}'
    found = caljson.entries(spark.createDataFrame([("f", body)], "file string, text string"))
    got = {r.label: (r.unit, list(r.vals), len(r.rows), [list(a) for a in r.axes]) for r in found.collect()}
    assert got == {"A_C": ("V", ["1.5"], 0, []), "B_CA": ("", ["1", "two", "3"], 0, []), "C_T": ("K", ["4", "5"], 0, [[0.0, 1.0]]), "D_M": ("K", [], 2, [[0.0, 1.0], [7.0, 8.0]])}


def test_instances_of_every_kind(spark):
    found = cdfx.instances(spark.createDataFrame([("f", samples.DESTINATION)], "file string, text string"))
    got = {r.label: (r.kind, len(r.rows) if r.kind == "MAP" else len(r.vals), r.pos) for r in found.collect()}
    assert got == {
        "A_C": ("SCALAR", 1, 0), "B_C": ("SCALAR", 1, 1), "Arr_CA": ("ARRAY", 3, 2), "Crv_T": ("CURVE", 4, 3), "Map_M": ("MAP", 3, 4), "Enum_M": ("MAP", 1, 5), "D_C": ("SCALAR", 1, 6), "E_C": ("SCALAR", 1, 7), "F_X": (None, 1, 8),
    }


PHRASES = [
    "must lie between 1 and 2.5", "min: -3, max= 4", "greater than 7", "at most 9", "no bound",
    "X: n_eng [rpm] [3] 1000 2000 3000 4000 Y: [-] [2] Start value: 1.5 2.5 [V]", "Start value (all) 4 [-]", "Start value: see Table 12", "raw 0...65535 phys −327.68 ... 327.67 [%]",
]


def test_phrases(spark):
    t = F.col("t")
    parsed = spark.createDataFrame(list(enumerate(PHRASES)), "id int, t string").select("id", text.limits(t).alias("l"), text.start_value(t).alias("s"), text.axes(t).alias("a"), text.physical_range(t).alias("r")).orderBy("id").collect()
    bounds = [tuple(r.l) if r.l else None for r in parsed]
    assert bounds == [(1.0, 2.5, "explicit_between"), (-3.0, 4.0, "explicit_min_max"), (7.0, None, "explicit_greater_than"), (None, 9.0, "explicit_less_than"), None, None, None, None, None]
    values = [(r.s["values"], r.s.unit, r.s.for_all) for r in parsed]
    assert values == [(None, None, False)] * 5 + [([1.5, 2.5], "V", False), ([4.0], "dimensionless", True), (None, None, False), ([327.67], "%", False)]
    assert [tuple(a) for a in parsed[5].a] == [("X", "n_eng", "rpm", 3, [1000.0, 2000.0, 3000.0]), ("Y", None, "dimensionless", 2, [1.5, 2.5])]
    assert all(not r.a for k, r in enumerate(parsed) if k != 5) and parsed[8].r.lower == -327.68


def test_phrases_read_at_once(spark):
    """The same as by each reader alone, and a text goes to Python once."""
    t = F.col("t")
    texts = [*PHRASES, None, "", "[all] X: 1 2", "all x 3 [", "see Table 5 start value 3 [V]", "MIN 1 MAX 2", "standardvalue: 7, 8"]
    df = spark.createDataFrame([(p,) for p in texts], "t string")
    readers = {"limits": text.limits, "start_value": text.start_value, "axes": text.axes, "physical_range": text.physical_range}
    for r in df.select(text.phrases(t).alias("p"), *[f(t).alias(name) for name, f in readers.items()]).collect():
        assert r.p.asDict() == {name: r[name] for name in readers}
    plan = formats.value_phrases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_labels_taken_apart(spark):
    df = spark.createDataFrame([("Mod_Inst.tiDelay_C",), ("Mod_facGain_T",), ("bad label",)], "label string")
    got = [tuple(r) for r in df.select(F.inline(F.array(text.label_parts(F.col("label"))))).collect()]
    assert got == [("Mod", "Inst", "ti", "Delay", "C", "VALUE"), ("Mod", None, "fac", "Gain", "T", "CURVE"), (None,) * 6]


def test_kinds_of_lines(spark):
    want = {
        "3.1 Fuel_Main": (True, True, True, False, "Fuel_Main", None), "3 [ab_]": (True, False, True, False, None, None), "3 [abc_d] 1": (True, False, True, False, "abc_d", None), "2 dsd_x y": (True, False, True, False, None, None),
        "Note:": (False, True, False, False, None, None), "  y: 1 2": (False, False, True, False, None, None), "TABLE 12 of": (False, False, True, False, None, None), "2026-01-02 was": (False, False, True, False, None, None),
        "Cautionary": (False, False, False, True, None, None), "Caution now": (False, False, True, True, None, None), "see (Mod_tiWait_C), there": (False, False, True, False, None, "Mod_tiWait_C"),
        "plain 12 words": (False, False, False, False, None, None), "": (False, False, False, False, None, None), None: (False, False, False, False, None, None),
    }
    line = F.col("line")
    kinds = [rows.is_heading(line), rows.is_section(line), rows.ends_row(line), rows.is_noise(line), rows.module_of(line), rows.label_in(line)]
    got = spark.createDataFrame([(g,) for g in want], "line string").select("line", *[k.alias(f"k{n}") for n, k in enumerate(kinds)])
    assert {r.line: tuple(r)[1:] for r in got.collect()} == want


def test_printed_maps_in_value_tables(spark):
    body = """Table 7
Mod_facGain_M of it
X: n_eng [rpm] [2]
Y: t_oil [K] [2]
Y/X
10 20
1 5 6
2 7 8
Table 8
Mod_tiWait_T
X 1 2
VAL 3
4"""
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(body.split("\n"))], "doc_id long, line_no int, line string")
    got = {r.table_id: (r.label, list(r.x), list(r.y), list(r.val), [a.signal for a in r.axes]) for r in pages.value_tables(lines).collect()}
    assert got == {"7": ("Mod_facGain_M", [10.0, 20.0], [1.0, 2.0], [5.0, 6.0, 7.0, 8.0], ["n_eng", "t_oil"]), "8": ("Mod_tiWait_T", [1.0, 2.0], [], [3.0, 4.0], [])}


def test_curves_as_rows(spark):
    df = spark.createDataFrame([("c", [5.0, 6.0], [1.0, 2.0]), ("all", [9.0], [1.0, 2.0, 3.0]), ("bare", [4.0], None)], "label string, vals array<double>, axis array<double>")
    got = sorted(map(tuple, extract.unpivoted(df, ["label"], "vals", "axis").collect()))
    assert got == [("all", 0, 1.0, 9.0), ("all", 1, 2.0, 9.0), ("all", 2, 3.0, 9.0), ("bare", 0, None, 4.0), ("c", 0, 1.0, 5.0), ("c", 1, 2.0, 6.0)]


def test_texts_equal(spark):
    rows = [("33.3008", "33.30078125", True), ("0", "1e-7", True), (" on", "on ", True), ("1d", "1", False), ("1", "1.01", False), ("a", None, False), (None, None, True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.select((compare.texts_equal(F.col("a"), F.col("b")) == F.col("want")).alias("ok")).where("not ok or ok is null").count() == 0


def test_destination_written_with_its_updates(spark):
    texts = spark.createDataFrame([("f", samples.DESTINATION)], "file string, text string")
    written = cdfx.instances(cdfx.merged(texts, formats.updates(spark).where("fragment is not null")))
    got = {r.label: ",".join(r.vals) for r in written.collect()}
    assert got == {"A_C": "33.30078125", "B_C": "on", "Arr_CA": "0.0,5.0,10.0", "Crv_T": "0.0,15.0,20.0,100.0", "Map_M": "", "Enum_M": "", "D_C": "6", "E_C": "1", "F_X": "1"}
