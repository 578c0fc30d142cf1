"""Corner cases of document rows, value tables, frames, embedding and the image's bytes."""

import struct

import pytest
from pyspark.sql import functions as F

from kalibra.functions import text as tx
from kalibra.operators import decode, embedding, frames, match, reconcile, rows, sequence
from kalibra.plans import formats, retrieval, samples, series, tables
from kalibra.sources import hexfile, tabular

LINES = "doc_id int, page int, line_no int, line string"


def test_rows_of_nothing(spark):
    none = spark.createDataFrame([], LINES)
    assert rows.label_rows(none).count() == rows.simple_calibration_rows(none).count() == 0
    blank = spark.createDataFrame([(1, 1, 0, None), (1, 1, 1, ""), (None, None, 0, "[apph_labtab]")], LINES)
    assert rows.label_rows(blank).count() == 0


def test_rows_stop_at_their_page_and_keep_repeats(spark):
    lines = spark.createDataFrame([(1, 1, 0, "[apph_labtab]"), (1, 1, 1, "Mod_tiA_C one"), (1, 2, 0, "two"), (1, 2, 1, "Mod_tiA_C one"), (2, 1, 0, "Mod_tiB_C no table")], LINES)
    assert sorted((r.page, r.text) for r in rows.label_rows(lines).collect()) == [(1, "Mod_tiA_C one"), (2, "Mod_tiA_C one")]
    assert [(r.doc_id, r.label, r.page) for r in rows.simple_calibration_rows(lines).orderBy("doc_id").collect()] == [(1, "Mod_tiA_C", 1), (2, "Mod_tiB_C", 1)]


def test_cleaned_labels(spark):
    given = ["(Mod_tiWait_C),", '"Mod_uBat_C"', "Mod tiWait", "", None]
    assert [r[0] for r in spark.createDataFrame([(g,) for g in given], "t string").select(rows.cleaned_label(F.col("t"))).collect()] == ["Mod_tiWait_C", "Mod_uBat_C", None, None, None]


def test_split_maps_of_nothing(spark):
    schema = "table_key string, x_size int, y_size int, line_no int, line string"
    assert rows.split_maps(spark.createDataFrame([], schema)).count() == 0
    short = spark.createDataFrame([("t", 2, 2, 0, "Y/X"), ("t", 2, 2, 1, "1 2 3"), ("u", None, None, 0, None)], schema)
    assert [(r.x, r.y, r.z) for r in rows.split_maps(short).collect()] == [([1.0, 2.0], [], [])]


def test_review_frames(spark):
    made = tables.review(spark)
    assert [tuple(r)[3:] for r in made["curves"].orderBy("x_index").collect()] == [("1", 0, 1.0, 3.0), ("1", 1, 2.0, 4.0)]
    assert [r.value for r in made["arrays"].orderBy("index").collect()] == [5.0, 6.0]
    assert made["scalars"].count() == 1 and made["calibration"].count() == 4


def test_detailed_log(spark):
    results = spark.createDataFrame([("A", "one", "updated"), ("B", "one", "copied"), ("C", None, "attention")], "label string, source string, status string")
    patch = decode.patch_events(formats.changes(spark), formats.one(spark, samples.DESCRIPTOR))
    notes = spark.createDataFrame([("error", "no bytes")], "kind string, text string")
    made = frames.detailed_log(reconcile.events(results, "label"), reconcile.source_summary(results), patch, notes)
    total = made["summary"].first().asDict()
    assert total == {"destination_labels": 3, "cdfx_updated": 1, "cdfx_copied_unchanged": 1, "attention_labels": 1, "pipeline_events_total": 3, "hex_patched": 3, "hex_skipped_no_char": 2, "hex_skipped_no_char_axis_pts": 1,
                     "hex_skipped_no_char_unknown": 1, "hex_skipped_no_layout": 1, "patch_events_total": 6, "hex_errors_total": 1, "hex_warnings_total": 0, "events_total": 9}
    assert made["events"].count() == 9 and [r.label for r in made["remaining"].collect()] == ["C"]
    assert {(r.label, r.skip_reason) for r in made["skipped"].collect()} == {("K_non_C", "missing_record_layout"), ("ax", "no_a2l_characteristic"), ("K_new_C", "no_a2l_characteristic")}
    for name, columns in frames.HEADERS.items():
        assert set(columns) <= set(made[name].columns)


def test_matches_are_written(spark, tmp_path):
    matches = spark.createDataFrame([("a", 0.5)], "label string, distance double")
    frames.write_matches(matches, matches.limit(0), spark.createDataFrame([("x\ny",)], "text string"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "matches")).collect()] == [("a", "0.5")]
    assert "x\ny" in "".join(p.read_text() for p in (tmp_path / "out" / "reports").glob("part*"))


def test_chunks_are_stored_once(spark):
    blocks = spark.createDataFrame([(1, "fn", "1.0", 0, "talk"), (1, "fn", "1.0", 1, "Mod_tiWait_C waits"), (1, "fn", "1.0", 2, "more")], "block_id int, name string, version string, line_no int, line string")
    empty = spark.createDataFrame([], "id string, function string, version string, role string, label string, anchor_line int, chunk_index int, text string, vector array<double>")
    cache = spark.createDataFrame([], "key string, vector array<double>")
    label = r"\b(Mod_\w+_C)\b"
    store, new = embedding.store_chunks(blocks, empty, cache, embedding.stand_in, "m", "old", label)
    assert [(r.label, r.role, r.text, len(r.vector)) for r in store.collect()] == [("Mod_tiWait_C", "old", "talk\nMod_tiWait_C waits\nmore", 64)] and new.count() == 1
    again, none = embedding.store_chunks(blocks, store, new, embedding.stand_in, "m", "old", label)
    assert again.count() == 1 and none.count() == 0


def test_reports(spark):
    matches = embedding.top_matches(retrieval.hits(spark, "/root/testdata/sf0.001"), 2)
    text = embedding.match_report(matches).orderBy("query_id").first().text
    assert text.startswith("1. ") and "\n   distance=0.0000\n   context: " in text and "\n\n2. " in text


def test_stores_are_resolved():
    assert embedding.resolved_store(["a", "b"], "b") == "b" and embedding.resolved_store(["a"], "x") == "a"
    for existing in ([], ["a", "b"]):
        with pytest.raises(LookupError):
            embedding.resolved_store(existing, "x")


def test_all_types_are_packed(spark):
    given = [("UBYTE", [-3.0, 2.5, 3.5, 999.0, None]), ("SWORD", [-40000.0, 1.5]), ("A_UINT64", [2.0**64, -1.0]), ("A_INT64", [-(2.0**63), float("nan")]), ("FLOAT16_IEEE", [1.5]), ("FLOAT64_IEEE", [1e300, None])]
    df = spark.createDataFrame([(k, 1, 0, v, k, True) for k, v in given], "file string, seq int, address long, raw array<double>, kind string, little boolean")
    got: dict = {}
    for r in decode.packed(df).orderBy("file", "at").collect():
        got[r.file] = got.get(r.file, b"") + bytes.fromhex(r.byte)
    assert got["UBYTE"] == bytes([0, 2, 4, 255, 0]) and got["SWORD"] == struct.pack("<hh", -32768, 2) and got["A_UINT64"] == struct.pack("<QQ", 2**64 - 1, 0)
    assert got["A_INT64"] == struct.pack("<qq", -(2**63), 0) and got["FLOAT16_IEEE"] == struct.pack("<e", 1.5) and got["FLOAT64_IEEE"] == struct.pack("<dd", 1e300, 0.0)


def test_written_equals_rendered_cells(spark):
    body = "\n".join([samples.hex_line(0, 5, bytes(range(30))), samples.hex_line(0, 8, bytes([99])), samples.hex_line(0, 60, b"\1\2"), samples.hex_line(4, 0, b"\0\1"), samples.hex_line(0, 0xFFFF, b"\7")])
    data = hexfile.records(formats.one(spark, body))
    patches = spark.createDataFrame([("f", 6, "AA", 1), ("f", 6, "BB", 2), ("f", 40, "CC", 1), ("f", 200, "DD", 1)], "file string, at long, byte string, seq int")
    lines = lambda df: sorted((r["at"], r["rank"], r["line"]) for r in df.collect())
    assert lines(hexfile.written(data, patches)) == lines(hexfile.rendered(hexfile.overlaid(data, patches)))


def test_decoded_values_patched_back_change_nothing(spark):
    texts, images = formats.one(spark, samples.DESCRIPTOR), formats.one(spark, samples.image())
    values = decode.decoded(texts, images).where("error is null and label not in ('K_odd_C', 'K_crv_T')")
    change = values.select("file", "label", F.lit(1).alias("seq"), "value", F.array("x_axis", "y_axis").alias("new_axes"))
    bytes_ = decode.patches(change, texts).unionByName(decode.axis_patches(change, texts))
    data = hexfile.records(images)
    lines = [r.line for r in hexfile.written(data, bytes_).orderBy("at", "rank").collect()]
    assert lines == samples.image().split()[:-1]


def test_map_cells_that_are_missing(spark):
    cell = "struct<num: double, txt: string>"
    df = spark.createDataFrame([("MAP", 2, 2, [[(1.0, None)], [(2.0, None), (3.0, None), (4.0, None)]]), ("CURVE", 1, 1, [[(1.0, None)], [(2.0, None)]])], f"kind string, nx int, ny int, r array<array<{cell}>>")
    got = [[v.num if v.num is not None else v.txt for v in r.f] for r in df.select(decode.flattened(F.col("r"), F.col("kind"), F.col("nx"), F.col("ny")).alias("f")).collect()]
    assert got == [[1.0, "", 2.0, 3.0], [1.0, 2.0]]


def test_files_end_to_end(spark, tmp_path):
    """Read, pair, decode, change, write and read again; the two files have different names."""
    (tmp_path / "one.a2l").write_text(samples.DESCRIPTOR)
    (tmp_path / "One.hex").write_text(samples.image())
    from kalibra.operators import pages
    from kalibra.sources import a2l

    texts, images = a2l.read(spark, str(tmp_path / "*.a2l")), hexfile.read(spark, str(tmp_path / "*.hex"))
    name = F.substring_index("file", "/", -1)
    pairs = pages.paired_files(texts.select(name.alias("name")), images.select(name.alias("name")))
    paired = images.withColumn("right_name", name).join(pairs, "right_name").select(F.col("left_name").alias("file"), "text")
    texts = texts.select(name.alias("file"), "text")
    before = {r.label: r.value for r in decode.decoded(texts, paired).where("error is null").collect()}
    assert len(before) == 8
    change = formats.changes(spark).withColumn("file", F.lit("one.a2l"))
    bytes_ = decode.patches(change, texts).unionByName(decode.axis_patches(change, texts))
    out = hexfile.written(hexfile.records(paired), bytes_)
    out.orderBy("at", "rank").select("line").coalesce(1).write.text(str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out" / "part*"), wholetext=True).select(F.lit("one.a2l").alias("file"), F.col("value").alias("text"))
    after = {r.label: r for r in decode.decoded(texts, again).where("error is null").collect()}
    number = lambda label: [v.num for v in after[label].value]
    assert number("K_flt_C") == [-0.25] and number("K_map_M") == [9.0, 0.0, 8.0, 7.0, 6.0, 255.0] and number("K_crv_T") == [200.0, 100.0, 100.0]
    assert [v.num for v in after["K_crv_T"].x_axis] == [0.0, 10.0, 20.0]
    assert all(after[label].value == before[label] for label in before if label not in ("K_flt_C", "K_map_M", "K_crv_T"))


def test_sheets_are_told_apart(spark):
    sheet = spark.createDataFrame([("a", 0, "L1", "F"), ("a", 1, "L2", ""), ("b", 0, "L3", "")], "file string, n int, label string, function string")
    got = {(r.file, r.label): r.function for r in tabular.grouped(sheet, "label", "function", "n", ["file"]).collect()}
    assert got == {("a", "L1"): "F", ("a", "L2"): "F", ("b", "L3"): None}


def test_label_pattern_has_no_empty_parts(spark):
    assert spark.range(1).select(tx.label_parts(F.lit("nolabel"))["name"].alias("n")).first().n is None


def test_maps_have_rows_and_tables_of_ranges_count(spark):
    ranges = samples.DESCRIPTOR.replace("/begin AXIS_PTS ax", '/begin COMPU_VTAB_RANGE t_verb "" 9 2 0 "low" 1 "high" /end COMPU_VTAB_RANGE /begin COMPU_METHOD c_form "" FORM "%1" "" FORMULA "X1*2" /end COMPU_METHOD /begin AXIS_PTS ax')
    texts = formats.one(spark, ranges)
    from kalibra.sources import a2l

    tabs = {r.tab: r for r in a2l.compu_tabs(texts).collect()}
    assert [p.txt for p in tabs["t_verb"].pairs] == ["low", "high"] and tabs["t_verb"].tab_type == "9"
    assert {r.conversion: r.formula for r in a2l.compu_methods(texts).collect()}["c_form"] == "X1*2"
    assert a2l.function_counts(texts).first().blocks == 2
    found = {r.label: r.cells for r in decode.decoded(formats.one(spark, samples.DESCRIPTOR), formats.one(spark, samples.image())).collect()}
    assert [[v.num for v in row] for row in found["K_map_M"]] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]] and found["K_lin_C"] is None


def test_columns_instead(spark):
    df = spark.createDataFrame([("a", "text")], "label string, Description string")
    assert tuple(tabular.canonical(df, {"label": [], "context": [], "description": []}, instead={"context": "description"}).first()) == ("a", "text", "text")


def test_axes_are_filled(spark):
    from kalibra.operators import pages

    axis = "struct<axis: string, signal: string, unit: string, size: int, breakpoints: array<double>>"
    df = spark.createDataFrame([(1, 0, [("X", "n", None, None, None)]), (1, 1, [("X", "m", "rpm", 2, [1.0, 2.0]), ("Y", None, "K", None, None)]), (2, 0, None)], f"record_id int, seq int, axes array<{axis}>")
    assert [(r.record_id, [tuple(a) for a in r.axes]) for r in pages.merged_axes(df).collect()] == [(1, [("X", "n", "rpm", 2, [1.0, 2.0]), ("Y", None, "K", None, None)])]


def test_group_totals(spark):
    labels = spark.createDataFrame([("A",), ("A",), ("B",)], "label string")
    blocks = spark.createDataFrame([("A", "F"), ("C", "F"), ("C", "G")], "label string, function string")
    assert tuple(reconcile.group_totals(labels, blocks).first()) == (2, 2, 1, 1)


def test_numbers_within_hot_and_null_keys(spark):
    given = [("hot", i * 7 % 101) for i in range(101)] + [(None, 5), (None, -3), ("one", 9), ("hot", None)]
    df = spark.createDataFrame(given, "k string, o int")
    got = {(r.k, r.o): (r.number, r["first"]) for r in sequence.numbered(df, ["k"], "o", buckets=8).collect()}
    assert got == {**{("hot", i): (i + 1, 0) for i in range(101)}, (None, -3): (1, -3), (None, 5): (2, -3), ("one", 9): (1, 9)}
    assert sequence.numbered(df.limit(0), ["k"], "o").count() == 0


def test_greedy_match_equals_plain_greedy(spark):
    """The query's rows against pairs taken one by one, the best first."""
    folder = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{folder}/conversations.parquet").where("text is not null").collect()
    pairs = spark.createDataFrame([(a.conv_id, a.turn, b.turn, a.text, b.text) for a in turns for b in turns if a.conv_id == b.conv_id and (a.role, b.role) == ("user", "assistant")], "c long, l long, r long, a string, b string")
    scored = sorted(((-p.s, p.c, p.l, p.r) for p in pairs.select("c", "l", "r", match.text_similarity("a", "b").alias("s")).collect() if p.s >= 10))
    left, right, want = set(), set(), set()
    for s, c, a, b in scored:
        if (c, a) not in left and (c, b) not in right:
            left.add((c, a))
            right.add((c, b))
            want.add((c, a, b, -s))
    got = [tuple(r[c] for c in ("conv_id", "left_id", "right_id", "score")) for r in series.greedy_match(spark, folder).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_ranges_are_dealt_in_parts_of_bounded_size(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), (F.col("id") % 1000).alias("n"))
    more = spark.createDataFrame([("odd", None), ("odd", 3), ("odd", 4), ("odd", 9), ("none", None), (None, 1)], "k string, n long")
    df = rows.unionByName(more)
    dealt = sequence.islands(df, ["k"], "n", most=50)
    assert dealt.rdd.getNumPartitions() == 4006 // 50 + 1
    got = {r.k: r.ranges for r in sequence.ranges_text(df, ["k"], "n", most=50).collect()}
    assert got["hot"] == ", ".join(str(n) for n in range(0, 1000, 2)) and got["k7"] == ", ".join(str(n) for n in range(7, 1000, 100))
    assert (got["odd"], got["none"], got[None], len(got)) == ("3-4, 9", None, "1", 54)
