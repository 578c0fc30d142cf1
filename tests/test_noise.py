"""Each kind of noise line and each reader's rules, by example."""

from pyspark.sql import functions as F

from kalibra.functions import noise

LINES = {
    "": {"blank"},
    " \t ": {"blank"},
    "|": {"bar"},
    "12 | 345": {"page_number"},
    "12|345": {"page_number"},
    "3.1 4": {"numbers"},
    "2024-01-31 | [PVER] more": {"stamp"},
    "2024-01-31 more | [PVER]": set(),
    "Fuel_Main 12.3.4;1": {"version"},
    "Fuel_Main  12.3.4": {"version"},
    "Fuel_Main 12.3.4;1 17 | 90": {"version_page", "running_head"},
    "see Fuel_Main 12.3.4;1 17 | 90 there": {"running_head"},
    "4.2 System  Constants": {"constants"},
    "4 SYSTEMCONSTANTS of it": {"constants"},
    "4 Systems constant": set(),
    "The maker reserves all rights, even to": {"rights", "legal"},
    "passing on to thirdparties": {"legal"},
    "Label name  Value": {"header", "editing"},
    "labelname Value": {"header"},
    "Do not edit these tables manually": {"editing"},
    "Copyright 2020 by no one": {"licence"},
    "Plain words, 3 of them": set(),
}


def test_kinds(spark):
    df = spark.createDataFrame([*((t,) for t in LINES), (None,)], "line string")
    got = {r.line: set(r.k) for r in df.select("line", noise.kinds(F.col("line")).alias("k")).collect()}
    assert got == {**LINES, None: {"blank"}}


def test_rules_name_known_kinds(spark):
    df = spark.createDataFrame([("4.2 System Constants",)], "line string").select(noise.kinds(F.col("line")).alias("k"))
    assert [df.select(noise.is_noise(F.col("k"), r)).first()[0] for r in ("page", "table", "continuation", "section")] == [False, True, False, False]
