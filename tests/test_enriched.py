"""Contexts with the texts of their spans, marks around lines, and the frames of a matching."""

import csv
import glob

from pyspark.sql import functions as F

from kalibra.operators import frames, linked

LINES = "doc_id long, line_no int, line string"


def test_spans_are_added_once(spark):
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(["head", "alpha  ", "beta", "", "gamma", "alpha", "beta"])] + [(2, 0, "other")], LINES)
    records = spark.createDataFrame([(1, 10, "see", "x"), (1, 11, None, "y"), (1, 12, "holds gamma already", "z"), (2, 10, "alone", "w"), (3, 1, "no lines", "v")], "doc_id long, record_id int, context string, more string")
    spans = [(1, 10, 1, 2), (1, 10, 5, 6), (1, 10, 4, 4), (1, 10, 3, 3), (1, 11, 0, 1), (1, 11, 0, 1), (1, 12, 4, 4), (1, 12, 6, 9), (2, 10, 5, 3), (3, 1, 0, 5)]
    for bucket in (2, 64):
        got = {(r.doc_id, r.record_id): r.context for r in linked.enriched(records, spark.createDataFrame(spans, "doc_id long, record_id int, first_line int, last_line int"), lines, bucket=bucket).collect()}
        assert got == {(1, 10): "see\nalpha\nbeta\ngamma", (1, 11): "head\nalpha", (1, 12): "holds gamma already\nbeta", (2, 10): "alone", (3, 1): "no lines"}
    assert linked.enriched(records.limit(0), spark.createDataFrame(spans, "doc_id long, record_id int, first_line int, last_line int"), lines).columns == records.columns


def test_marks_nearby(spark):
    lines = spark.createDataFrame([(1, n, "Table 7" if n in (4, 20) else "x") for n in range(25)], LINES)
    mark = F.when(F.col("line") != "x", F.col("line_no"))
    got = {r.line_no: r.at for r in linked.marks_nearby(lines, ["doc_id"], ["line_no"], mark, "at", most=5, parts=4, block=5).collect()}
    assert got == {n: 4 if 3 <= n <= 7 else 20 if 19 <= n <= 23 else None for n in range(25)}


def test_match_workbook(spark, tmp_path):
    columns = "id long, function string, label string, description string, value string, value_type string, suffix string, pages string, context string"
    row = lambda i, function, label: (i, function, label, f"d{i}", "1", "Scalar", "_C", "3", "ctx")
    source = spark.createDataFrame([row(1, "F1", "A_C"), row(2, " ", "B_C"), row(3, "F1", "C_C")], columns)
    destination = spark.createDataFrame([row(7, "G", "X_C"), row(8, "F2", "Y_C"), row(9, None, "Z_C")], columns)
    pairs = spark.createDataFrame([(1, 9, 80.0), (2, 8, 91.25), (3, 7, 70.5)], "left_id long, right_id long, score double")
    found = frames.match_frames(source, destination, pairs, 70.0)
    assert list(found) == ["Source", "Destination", "Matched", "Summary", "Function Breakdown"]
    assert [tuple(r) for r in found["Summary"].collect()] == [("Total Semantic Matches", 3.0), ("Average Context Similarity %", 80.58), ("Threshold Used (>= 70.0%)", 70.0)]
    assert sorted(map(tuple, found["Function Breakdown"].collect())) == [("F1", 2, 75.25), ("F2", 1, 91.25)]
    frames.write_match_frames(found, str(tmp_path / "out"))
    read = []
    for name in sorted(glob.glob(f"{tmp_path}/out/Matched/part-*")):
        with open(name, encoding="utf-8-sig", newline="") as f:
            read += list(csv.DictReader(f))
    assert [r["Source Label"] for r in read] == ["B_C", "A_C", "C_C"] and read[0]["Destination Description"] == "d8" and "_order" not in read[0]
    none = frames.match_frames(source, destination, pairs.limit(0), 70.0)
    assert none["Function Breakdown"].count() == 0 and none["Summary"].first()["Value"] == 0
