"""Properties and corners that the query comparisons do not reach."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kalibra.functions import compare, convert, numeric, text
from kalibra.functions import labels as label_functions
from kalibra.operators import decode, extract, frames, linked, match, pages, reconcile, scan, sequence, update
from kalibra.plans import labels, samples
from kalibra.sources import cdfx, hexfile, tabular


def one(spark, body):
    return spark.createDataFrame([("f", body)], "file string, text string")


def test_resampling_to_own_places_is_identity(spark):
    rng = random.Random(1)
    rows = [(i, sorted(rng.sample(range(100), n)), [rng.uniform(-5, 5) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 7, 20])]
    df = spark.createDataFrame([(i, [float(v) for v in x], v) for i, x, v in rows], "id int, x array<double>, v array<double>")
    got = df.select("id", numeric.interpolated(numeric.repaired(F.col("x"), F.col("v")), F.col("x")).alias("a"), numeric.resampled(F.col("v"), F.size("v")).alias("b")).collect()
    for r in got:
        assert r.a == pytest.approx(rows[r.id][2]) and r.b == pytest.approx(rows[r.id][2])


def test_first_source_covers_every_label_once(spark):
    sources = [(n, spark.createDataFrame([(k, n) for k in keys], "label int, value string")) for n, keys in (("a", [1, 2, 2]), ("b", [2, 3]), ("c", [1, 4]))]
    got = {r.label: r.source for r in reconcile.first_source(reconcile.stacked(sources), "label", ["value"]).collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: "c"}


def test_image_without_patches_is_unchanged(spark):
    data = hexfile.records(one(spark, samples.image()))
    none = spark.createDataFrame([], "file string, at long, byte string, seq int")
    lines = [r.line for r in hexfile.rendered(hexfile.overlaid(data, none)).orderBy("at", "rank").collect()]
    assert lines == samples.image().split()[:-1]
    assert all(sum(bytes.fromhex(line[1:])) % 256 == 0 for line in lines)


def test_decode_then_encode_gives_the_same_bytes(spark):
    texts, images = one(spark, samples.DESCRIPTOR), one(spark, samples.image())
    values = decode.decoded(texts, images).where("error is null and label not in ('K_flt_C', 'K_odd_C', 'K_crv_T')").select("file", "label", F.lit(1).alias("seq"), "value")
    data = hexfile.records(images)
    assert hexfile.overlaid(data, decode.patches(values, texts)).exceptAll(hexfile.cells(data)).count() == 0


def test_overlapping_records_take_the_last(spark):
    body = "\n".join([samples.hex_line(0, 0, bytes([1, 2, 3])), samples.hex_line(0, 1, bytes([9]))])
    assert {r.at: r.byte for r in hexfile.cells(hexfile.records(one(spark, body))).collect()} == {0: "01", 1: "09", 2: "03"}


def test_big_endian_and_types_across_pages(spark):
    import struct

    body = samples.hex_line(0, 60, struct.pack(">f", -2.5) + struct.pack(">h", -3) + struct.pack(">d", 1e300))
    reads = spark.createDataFrame([("f", "a", 60, "FLOAT32_IEEE", 1, False), ("f", "b", 64, "SWORD", 1, False), ("f", "c", 66, "FLOAT64_IEEE", 1, False), ("f", "d", 60, "odd", 2, True), ("f", "e", 70, "UWORD", 9, True)], "file string, read_id string, address long, kind string, count int, little boolean")
    got = {r.read_id: r.raw for r in hexfile.typed(reads, hexfile.records(one(spark, body))).collect()}
    assert got["a"] == [-2.5] and got["b"] == [-3.0] and got["c"] == [1e300] and len(got["d"]) == 2 and got["e"] is None


def test_namespaced_document_reads_the_same(spark):
    spaced = samples.SOURCE_ONE.replace("<SW-", "<n:SW-").replace("</SW-", "</n:SW-").replace("<n:SW-INSTANCE-", "<SW-INSTANCE-").replace("</n:SW-INSTANCE-", "</SW-INSTANCE-")
    plain, other = (cdfx.instances(one(spark, t)).drop("fragment") for t in (samples.SOURCE_ONE, spaced))
    assert plain.exceptAll(other).count() == 0 and other.count() == plain.count()


def test_broken_document_gives_no_rows(spark):
    assert cdfx.instances(one(spark, "<not closed")).count() == 0


def test_number_text_reads_back(spark):
    values = [0.0, -1.5, 1e-5, 2.5e-4, 12345678.9, 1e15, 1e16, 3e300, 0.1, 100.0]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(cdfx.number_text(F.col("v")).alias("t")).collect()]
    assert got == [repr(v) for v in values]


def test_map_of_labels_and_ragged_rows(spark):
    source = samples.container(samples.instance("E_M", samples.rows(("r1", 1, 2), ("r2", 3)), samples.axis("a", "b") + samples.axis("r1", "r2")))
    target = samples.container(samples.instance("E_M", samples.rows(("r2", 0, 0), ("zz", 0, 0)), samples.axis("b", "q") + samples.axis("r2", "zz")))
    got = update.updated([("s", cdfx.instances(one(spark, source)))], cdfx.instances(one(spark, target))).first()
    assert got.status == "updated" and got.cells == [[3.0, 3.0], [3.0, 3.0]] and got.x is None


def test_text_curve_takes_nearest_by_place(spark):
    source = samples.container(samples.instance("T_T", samples.cells("p", "q"), samples.axis(0, 1)))
    target = samples.container(samples.instance("T_T", samples.cells("-", "-", "-"), samples.axis(0, 1, 2)))
    got = update.updated([("s", cdfx.instances(one(spark, source)))], cdfx.instances(one(spark, target))).first()
    assert got.texts == ["p", "p", "q"] and got.status == "updated"


def test_lists_of_texts_and_numbers(spark):
    df = spark.createDataFrame([(["1", "x"],), (["1", "2"],), ([],)], "v array<string>")
    got = df.select(compare.all_numbers(F.col("v")).alias("a"), compare.only_numbers(F.col("v")).alias("o"), compare.lists_equal(F.col("v"), F.array(F.lit("1.00001"), F.lit("x"))).alias("same")).collect()
    assert [r.a for r in got] == [None, [1.0, 2.0], None] and [r.o for r in got] == [[1.0], [1.0, 2.0], []] and [r.same for r in got] == [True, False, False]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="label"):
        tabular.canonical(spark.createDataFrame([(1,)], "other int"), {"label": ["name"]}, ["label"])


def test_greedy_pairs_use_bonus_for_order_alone(spark):
    rows = [(1, 1, 1, 80.0, 0.0), (1, 1, 2, 79.0, 2.0), (1, 2, 1, 60.0, 50.0), (2, 1, 1, 10.0, 99.0)]
    got = match.greedy_pairs(spark.createDataFrame(rows, "g long, left_id long, right_id long, score double, bonus double"), "g", 70.0)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 79.0)]


def test_mean_vector_counts_odd_lengths_in_the_divisor(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 3.0]), ("a", 2, [3.0, 5.0]), ("a", 3, [9.0])], "k string, n int, v array<double>")
    assert match.mean_vector(df, "k", "v", "n").first()["mean"] == pytest.approx([4 / 3, 8 / 3])


def test_embedder_is_deterministic_and_unit_length(spark):
    df = spark.createDataFrame([("alpha beta gamma",), ("alpha beta gamma",), ("c",), (None,)], "t string")
    got = match.embedded(df, "t").collect()
    assert len(got) == 2 and all(sum(x * x for x in r.vector) == pytest.approx(1) for r in got)


def test_intervals_runs_and_records_of_nothing(spark):
    none = spark.createDataFrame([], "k int, s int, e int")
    assert scan.merged_intervals(none, ["k"], "s", "e").count() == 0
    assert extract.records(spark.createDataFrame([], "doc_id long, page int, line_no int, line string")).count() == 0
    assert pages.value_tables(spark.createDataFrame([], "doc_id long, line_no int, line string")).count() == 0


def test_explicit_values_keep_their_digits(spark):
    texts = ["0,1,2", " 1 ; 1 ", "(all) 0|x", "5", "a b", "1 2", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [list(r.v) for r in df.select("i", text.explicit_values(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [["0", "1", "2"], ["1", "1"], ["0", "x"], ["5"], ["a b"], ["1", "2"], []]


def test_fitted_and_units(spark):
    row = spark.range(1).select(text.fitted(F.array().cast("array<string>"), F.lit(3)).alias("none"), text.unit(F.lit("−")).alias("u"), text.unit(F.lit(" V ")).alias("v")).first()
    assert row.none == [] and (row.u, row.v) == ("dimensionless", "V")


def test_interpolated_tables_give_the_first_nearest_entry(spark):
    got = {r.kind: (r.physical, r.raw) for r in labels.conversion_round_trip(spark, "").collect()}
    assert got["TAB_INTP"] == ("150.0", "0.0")
    pairs = "array(named_struct('raw', 10D, 'num', 200D, 'txt', '200'), named_struct('raw', 0D, 'num', 100D, 'txt', '100'))"
    none = F.lit(None)
    raw = lambda num: convert.stored(F.lit(num), none.cast("string"), F.lit("TAB_INTP"), none.cast("array<double>"), none.cast("array<double>"), F.expr(pairs))
    assert tuple(spark.range(1).select(raw(150.0), raw(149.0), raw(500.0)).first()) == (10.0, 0.0, 10.0)


def test_searches_ask_every_fiftieth_row_over_many_tiles(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(240)] + [(240, 0, [0.0] * 4), (241, 0, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    d = lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for more in ({}, {"within": True, "itself": True}, {"per_label": True}):
        want = set()
        for q, of, a in rows[:240:50]:
            near = sorted((d(a, v), i, x) for i, x, v in rows[:240] if ("itself" in more or i != q) and ("within" not in more or x == of))
            parts = [[p for p in near if p[2] == x] for x in range(3)] if "per_label" in more else [near]
            want |= {(q, i, n + 1) for part in parts for n, (_, i, _) in enumerate(part[:7])}
        got = match.nearest_in_tiles(df, F.col("vec_id") % 50 == 0, 7, block=50, query_block=2, **more)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want


def test_named_tables_want_equal_entries(spark):
    pairs = "array(named_struct('raw', 0D, 'num', 5D, 'txt', '5'), named_struct('raw', 1D, 'num', 9.5D, 'txt', '9.5'), named_struct('raw', 2D, 'num', 5D, 'txt', 'five'))"
    none = F.lit(None)
    raw = lambda num, txt, kind: convert.stored(F.lit(num).cast("double"), F.lit(txt).cast("string"), F.lit(kind), none.cast("array<double>"), none.cast("array<double>"), F.expr(pairs))
    got = spark.range(1).select(raw(7.0, None, "TAB_NOINTP"), raw(9.5, None, "TAB_VERB"), raw(5.0, None, "TAB_VERB"), raw(None, "five", "TAB_VERB"), raw(None, "six", "TAB_VERB")).first()
    assert tuple(got) == (7.0, 1.0, 0.0, 2.0, None)


def test_attributes_and_malformed_instances(spark):
    rows = '<VG ID="1"><LABEL>r1</LABEL><V>1</V><V>2</V></VG><VG><LABEL>r2</LABEL><V>3</V><V>4</V></VG>'
    whole = samples.instance("A_M", rows, samples.axis(0, 1).replace("<SW-AXIS-CONT>", '<SW-AXIS-CONT CLASS="x">') + samples.axis(5, 6))
    bad = samples.instance("B_C", samples.cells(1)).replace("<SHORT-NAME>", "<SHORT-NAME><X>")
    texts = one(spark, samples.container(whole + bad + samples.instance("C_C", samples.cells(7))))
    got = {r.label: r for r in cdfx.instances(texts).collect()}
    assert set(got) == {"A_M", "C_C"} and [r.vals for r in got["A_M"].rows] == [["1", "2"], ["3", "4"]]
    assert (got["A_M"].x_axis, got["A_M"].y_axis) == (["0", "1"], ["5", "6"])
    assert [r.pos for r in cdfx.broken(texts).collect()] == [1]


def test_header_forms(spark):
    rows = ["FC: Abc / 1.2; 3", "x [ Def_g 1400.0.0;2 ] y", "  Ghi 7 ; 1 rest", "no header 1.2", "[Two 1;1] FC: One / 2;2"]
    lines = spark.createDataFrame([(1, n, 0, t) for n, t in enumerate(rows)], "doc_id int, page int, line_no int, line string")
    got = {r.page: (r.name, r.version) for r in pages.page_headers(lines).collect()}
    assert got == {0: ("abc", "1.2;3"), 1: ("def_g", "1400.0.0;2"), 2: ("ghi", "7;1"), 4: ("one", "2;2")}


def test_mean_vector_takes_the_first_length(spark):
    df = spark.createDataFrame([("a", 1, [9.0]), ("a", 2, [1.0, 3.0]), ("a", 3, [3.0, 5.0])], "k string, n int, v array<double>")
    assert match.mean_vector(df, "k", "v", "n").first()["mean"] == [3.0]


def test_events_of_skipped_and_padded(spark):
    rows = spark.createDataFrame([("s", "a", "skipped", False), ("s", "b", "updated", True)], "source string, label string, status string, ragged boolean")
    got = sorted((r.label, r.action, r.reason is not None) for r in reconcile.events(rows, "label").collect())
    assert got == [("a", "skipped", True), ("b", "padded", True), ("b", "updated", True)]


def test_keys_of_odd_texts(spark):
    deep = '{"k":' * 500 + "1" + "}" * 500
    texts = ['{"a:b": ":", "c": "x\\\\\\"y:", "d": [{"e": 1}, ["f:"]], "g": {"h": "{\\"i\\": 1}"}}', deep, '[{"a": 1}]', "7", "", "{broken", '{"long": "' + "x\\\\n" * 100_000 + '"}', None]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    assert [r.n for r in text.key_counts(got, "id", "body").orderBy("id").collect()] == [5, 500, 0, 0, 0, 0, 1]


def test_keys_of_two_million_texts(spark):
    rows = spark.range(2_000_000).select((F.col("id") % 3).alias("id"), F.lit('{"a": {"b": 1}, "c": [{"d": 1}]}').alias("body"))
    assert {r.id: r.n for r in text.key_counts(rows, "id", "body").collect()} == {0: 2_000_001, 1: 2_000_001, 2: 1_999_998}


def test_keys_at_every_depth_leave_no_view(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 1, "c": {"d": 2}}, "e": 3}'), (2, "{}"), (3, None)], "id int, body string")
    assert sorted(map(tuple, text.key_counts(rows, "id", "body").collect())) == [(1, 5), (2, 0)]
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_label_texts_of_a_table_block(spark):
    rows = [(1, 1, n, t) for n, t in enumerate(["Table 4 values", "X 1 2", "A_T 5 6", " 7 8", "[ B_C ] 9", "10 ", "A_T 11"])]
    got = {r.label: r.text for r in linked.label_texts(spark.createDataFrame(rows, "doc_id int, block int, line_no int, line string")).collect()}
    assert got == {"A_T": "Table 4 values\nA_T 5 6\n 7 8\nA_T 11", "B_C": "Table 4 values\n[ B_C ] 9\n10"}


def test_frames(spark):
    records = spark.createDataFrame([("A_C", "1", "V", "c", "d", 3, True)], "label string, start_value string, unit string, condition string, description string, page int, reconstructed boolean")
    assert tuple(frames.start_value_frame(records).first()) == ("A_C", "1", "V", "c", "d", 3, "YES", "text")
    log = spark.createDataFrame([("A", "updated"), ("B", "updated"), ("C", "missing")], "label string, status string")
    patch = spark.createDataFrame([("A", "patched", None), ("B", "error", "no bytes"), ("C", "warning", "clamped")], "label string, kind string, text string")
    made = frames.apply_frames(log, patch)
    assert {tuple(r) for r in made["summary"].collect()} == {("updated", 2), ("missing", 1)} and tuple(made["patch"].first()) == (1, 0, 0, 0, 1, 1)
    assert [r.error for r in made["errors"].collect()] == ["no bytes"] and [r.warning for r in made["warnings"].collect()] == ["clamped"]
    events = spark.createDataFrame([("s", "A", "updated", "reconcile", "r"), (None, "B", "attention", "reconcile", "q")], "source string, label string, action string, stage string, reason string")
    run = frames.run_frames(events)
    assert tuple(run["summary"].first()) == (2, 1, 0, 1, 0, 2) and [r.label for r in run["attention"].collect()] == ["B"]
    kinds = frames.missing_kinds(spark.createDataFrame([("A",), ("B",)], "label string"), spark.createDataFrame([("B",), ("B",)], "label string"))
    assert {tuple(r) for r in kinds.collect()} == {("A", "unknown"), ("B", "axis_points")}


def test_decoded_labels_as_json(spark):
    got = {r.label: json.loads(r.json) for r in frames.label_json(decode.decoded(one(spark, samples.DESCRIPTOR), one(spark, samples.image()))).collect()}
    assert got["K_lin_C"] == {"label": "K_lin_C", "kind": "VALUE", "value": 20.0} and got["K_on_C"]["value"] == "on" and got["K_arr_CA"]["value"] == [5.0, -2.0, 300.0]
    assert "K_gap_C" not in got


def test_subset_and_doctype(spark):
    texts = one(spark, samples.DESTINATION)
    kept = cdfx.subset(texts, spark.createDataFrame([("B_C",), ("A_C",), ("B_C",)], "label string"))
    assert [r.label for r in cdfx.instances(kept).orderBy("pos").collect()] == ["A_C", "B_C"]
    assert "<!DOCTYPE MSRSW>" in cdfx.documents(cdfx.fragments(texts).select("file", "pos", "fragment"), "MSRSW").first().text


def test_transposed_and_primary_value(spark):
    row = spark.range(1).select(numeric.transposed(F.expr("array(array(1D, 2D, 3D), array(4D, 5D))")).alias("t"), *[label_functions.primary_value(F.lit(t)) for t in ("x Start value: 5 [s] 7", "a 1 b 2.5", "no  number", "Initial value 3")]).first()
    assert row[0] == [[1.0, 4.0], [2.0, 5.0], [3.0, None]] and tuple(row)[1:] == ("5", "1, 2.5", "no number", "3")


def test_rounded_as_sql_rounds(spark):
    """Values near zero keep their sign, halves go by the product; compared as text, since -0.0 equals 0.0."""
    rng = random.Random(4)
    values = [-3e-7, 3e-7, -0.0, 0.0, 1.005, 2.675, -1.005, 0.5e-6, -0.5e-6, 1e300, float("inf"), float("-inf"), float("nan"), None, 4503599627370497.5, *[rng.randrange(-10**6, 10**6) / 128 for _ in range(50)], *[rng.uniform(-1, 1) for _ in range(50)]]
    for places in (2, 6):
        got = spark.createDataFrame([(v,) for v in values], "v double").select(numeric.rounded(F.col("v"), places).alias("r")).collect()
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?::INTEGER)", [v, places]).fetchone()[0] for v in values]
        assert [repr(r.r) for r in got] == list(map(repr, want))
