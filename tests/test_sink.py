"""Sorted sinks: many files, one order; records held open over pages."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from kalibra.operators import pages, sink


def test_rows_come_back_in_order_from_many_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "m1", None, ""]), f"l{rng.randrange(500)}", i) for i in range(3000)]
    path = str(tmp_path / "out")
    sink.write_sorted(spark.createDataFrame(rows, "module string, label string, i long").repartition(4), ["module", "label", "i"], path, files=9)
    got = [(r.module, r.label, r.i) for r in sorted(sink.read_sorted(spark, path).collect(), key=lambda r: r.row)]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    manifest = spark.read.parquet(f"{path}/{sink.MANIFEST}").orderBy("file").collect()
    assert len(manifest) >= 7 and max(m.n_rows for m in manifest) < 1000
    assert [m.first_row for m in manifest] == [sum(x.n_rows for x in manifest[:k]) for k in range(len(manifest))]


def test_csv_files_in_order_with_byte_marks(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [(k % 5, f'l "{k}", x', [1, k], None) for k in range(40)]
    sink.write_csv(spark.createDataFrame(rows, "module int, label string, vals array<int>, unit string"), ["module", "label"], path, files=3)
    read = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, encoding="utf-8-sig", newline="") as f:
            own = list(csv.DictReader(f))
            assert open(name, "rb").read(3) == b"\xef\xbb\xbf" and list(own[0]) == ["module", "label", "vals", "unit"]
            read += own
    assert [(int(r["module"]), r["label"], r["vals"], r["unit"]) for r in read] == sorted((m, t, f"[1,{v[1]}]", "") for m, t, v, _ in rows)


def test_nothing_to_sort(spark, tmp_path):
    sink.write_sorted(spark.createDataFrame([], "a int"), ["a"], str(tmp_path / "none"), files=3)
    assert sink.read_sorted(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("most", [10, 10_000])
def test_records_stay_open_over_pages(spark, most):
    """Line by line, with one document of most lines."""
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"d{rng.randrange(5)}", k // 40, k % 40, rng.choice(["open", "both", "close", "noise", "text", "text", "text", None])) for k in range(1200)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string").repartition(3)
    line = F.col("line")
    held = pages.open_records(lines, ["doc_id"], ["page", "line_no"], line.isin("open", "both"), line.isin("close", "both"), line == "noise", most=most, parts=6)
    want, open_at = set(), {}
    for doc, page, no, text in sorted(rows, key=lambda r: r[:3]):
        if text in ("open", "both"):
            open_at[doc] = (page, no)
        elif text == "close":
            open_at[doc] = None
        if open_at.get(doc) and text not in ("noise", "close"):
            want.add((doc, page, no, open_at[doc]))
    assert {(r.doc_id, r.page, r.line_no, tuple(r.record)) for r in held.collect()} == want


def test_open_records_fill_nulls_only(spark):
    rows = [(1, 0, 0, "A_C unit V", "A_C", None, "V"), (1, 0, 1, "heading of a page", None, None, None), (1, 1, 0, "12 | 40", None, "12", None), (1, 1, 1, "goes on with 5 mV", None, "5", "mV"), (1, 1, 2, "3.1 Next", None, "3.1", None), (1, 1, 3, "lost 9", None, "9", None)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string, label string, value string, unit string")
    line = F.col("line")
    held = pages.open_records(lines, ["doc_id"], ["page", "line_no"], F.col("label").isNotNull(), line.startswith("3.1"), line.rlike(r"^\d+ \|"))
    rows = held.select(F.struct("doc_id", "record").alias("record_id"), F.struct("page", "line_no").alias("seq"), "label", "value", "unit", F.col("line").alias("context"))
    assert [tuple(r)[1:] for r in pages.continued(rows).collect()] == [("A_C", "5", "V", "A_C unit V | heading of a page | goes on with 5 mV")]
    golden = [(1, 0, "A_C", None, "V", "first"), (1, 1, None, "5", "mV", "second"), (1, 2, None, "6", None, "first"), (2, 0, "B_C", None, None, "x"), (2, 1, None, None, "K", "x")]
    got = pages.continued(spark.createDataFrame(golden, "record_id long, seq int, label string, value string, unit string, context string"))
    assert sorted(map(tuple, got.collect())) == [(1, "A_C", "5", "V", "first | second"), (2, "B_C", None, "K", "x")]
