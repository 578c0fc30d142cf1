"""Descriptor files: blocks and their tokens as typed tables.

Every function takes ``texts(file, text)``, one row per descriptor, and returns a table keyed by ``file``; within a file
the last block of a name counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMENT = r'("(?:[^"\\]|\\.)*")|/\*(?s:.*?)\*/|//[^\n]*'
TOKEN = r'"(?:[^"\\]|\\.)*"|[^\s"]+'
# Numbers that follow a keyword of a conversion.
COEFFICIENTS, LINEAR = 6, 2
# The kinds of conversion tables.
TABS = ["COMPU_VTAB", "COMPU_TAB", "COMPU_VTAB_RANGE"]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def stripped(text: Column) -> Column:
    """Without comments; comment marks inside quotes stay."""
    return F.regexp_replace(text, COMMENT, "$1")


def tokens(body: Column) -> Column:
    """White space separates; a quoted string is one token, without its quotes."""
    return F.transform(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.startswith('"') & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))


def bodies(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)/begin\s+{kind}\b(.*?)/end\s+{kind}\b"), F.lit(1))


def after(found: Column, keyword: str, offset: int) -> Column:
    """The token ``offset`` places after the keyword, null without it."""
    at = F.array_position(found, keyword)
    return F.when(at > 0, F.get(found, (at - 1 + offset).cast("int")))


def numbers_after(found: Column, keyword: str, n: int) -> Column:
    at = F.array_position(found, keyword).cast("int")
    return F.when(at > 0, F.transform(F.slice(found, at + 1, n), lambda t: t.try_cast("double")))


def address(token: Column) -> Column:
    """0x... or decimal, a comma at the end ignored."""
    t = F.rtrim(token, F.lit(","))
    return F.when(F.lower(t).startswith("0x"), F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10)).otherwise(t).try_cast("long")


def _blocks(texts: DataFrame, kind: str, least: int) -> DataFrame:
    """(file, seq, body, t, name) of the blocks with at least ``least`` tokens, the last of each name."""
    found = texts.select("file", F.posexplode(bodies(stripped(F.col("text")), kind)).alias("seq", "body"))
    outer = F.regexp_replace("body", r"(?s)/begin\s+(\w+)\b.*?/end\s+\1\b", " ")
    cut = found.select("file", "seq", "body", tokens(outer).alias("t")).where(F.size("t") >= least).withColumn("name", F.get("t", F.lit(0)))
    return cut.withColumn("_n", F.row_number().over(Window.partitionBy("file", "name").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def byte_orders(texts: DataFrame) -> DataFrame:
    """(file, little): MSB_LAST, and no order at all, is little-endian, anything else big."""
    order = F.regexp_extract(stripped(F.col("text")), r"BYTE_ORDER\s+(\w+)", 1)
    return texts.select("file", order.isin("", "MSB_LAST").alias("little"))


def record_layouts(texts: DataFrame) -> DataFrame:
    t = F.col("t")
    return _blocks(texts, "RECORD_LAYOUT", 1).select(
        "file", F.col("name").alias("layout"),
        F.coalesce(after(t, "FNC_VALUES", 2), F.lit("UWORD")).alias("value_type"), F.coalesce(after(t, "FNC_VALUES", 3), F.lit("ROW_DIR")).alias("index_mode"),
        F.coalesce(after(t, "AXIS_PTS_X", 2), F.lit("UWORD")).alias("axis_type"),
    )


def compu_methods(texts: DataFrame) -> DataFrame:
    t = F.col("t")
    return _blocks(texts, "COMPU_METHOD", 5).select(
        "file", F.col("name").alias("conversion"), F.get(t, F.lit(2)).alias("conversion_type"), F.get(t, F.lit(4)).alias("unit"),
        numbers_after(t, "COEFFS", COEFFICIENTS).alias("coeffs"), numbers_after(t, "COEFFS_LINEAR", LINEAR).alias("linear"), after(t, "COMPU_TAB_REF", 1).alias("tab"), after(t, "FORMULA", 1).alias("formula"),
    )


def compu_tabs(texts: DataFrame) -> DataFrame:
    """(file, tab, tab_type, pairs array<struct<raw, num, txt>>, default_text); the last default counts, and of blocks of
    several kinds with one name that of the last of ``TABS``."""
    t = F.col("t")
    kinds = reduce(DataFrame.unionByName, [_blocks(texts, kind, 4).withColumn("_kind", F.lit(n)) for n, kind in enumerate(TABS)])
    both = kinds.groupBy("file", "name").agg(F.max_by("t", "_kind").alias("t"))
    count = F.coalesce(F.get(t, F.lit(3)).try_cast("int"), F.lit(0))
    pairs = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.get(t, 4 + 2 * i).try_cast("double").alias("raw"), F.get(t, 5 + 2 * i).try_cast("double").alias("num"), F.get(t, 5 + 2 * i).alias("txt")),
    )
    usable = F.filter(pairs, lambda p: p["raw"].isNotNull() & p["txt"].isNotNull())
    back = F.reverse(t)
    default = F.when(F.array_position(back, "DEFAULT_VALUE") > 1, F.get(back, (F.array_position(back, "DEFAULT_VALUE") - 2).cast("int")))
    return both.select("file", F.col("name").alias("tab"), F.get(t, F.lit(2)).alias("tab_type"), usable.alias("pairs"), default.alias("default_text"))


def axis_points(texts: DataFrame) -> DataFrame:
    t = F.col("t")
    rows = _blocks(texts, "AXIS_PTS", 10).select(
        "file", F.col("name").alias("axis"), address(F.get(t, F.lit(2))).alias("address"), F.get(t, F.lit(4)).alias("layout"), F.get(t, F.lit(6)).alias("conversion"),
        F.get(t, F.lit(7)).try_cast("int").alias("points"),
    )
    return rows.where("address is not null and points is not null")


def characteristics(texts: DataFrame) -> DataFrame:
    """(file, label, description, kind, address, layout, conversion, lower, upper, matrix_dim, number, axes)."""
    t = F.col("t")
    axis = lambda b: F.struct(
        F.get(tokens(b), F.lit(0)).alias("attribute"), F.get(tokens(b), F.lit(2)).alias("conversion"), F.get(tokens(b), F.lit(3)).try_cast("int").alias("points"), after(tokens(b), "AXIS_PTS_REF", 1).alias("ref")
    )
    dims = F.filter(F.coalesce(numbers_after(t, "MATRIX_DIM", 3), F.array().cast("array<double>")), lambda v: v.isNotNull())
    rows = _blocks(texts, "CHARACTERISTIC", 9).select(
        "file", F.col("name").alias("label"), F.get(t, F.lit(1)).alias("description"), F.get(t, F.lit(2)).alias("kind"), address(F.get(t, F.lit(3))).alias("address"),
        F.get(t, F.lit(4)).alias("layout"), F.get(t, F.lit(6)).alias("conversion"), F.get(t, F.lit(7)).try_cast("double").alias("lower"), F.get(t, F.lit(8)).try_cast("double").alias("upper"),
        F.transform(dims, lambda v: v.cast("int")).alias("matrix_dim"), after(t, "NUMBER", 1).try_cast("int").alias("number"),
        F.transform(bodies(F.col("body"), "AXIS_DESCR"), axis).alias("axes"),
    )
    return rows.where("address is not null")


def functions(texts: DataFrame) -> DataFrame:
    """(file, label, function, version): labels of each function block's first list; a label's last block counts."""
    found = texts.select("file", F.posexplode(bodies(stripped(F.col("text")), "FUNCTION")).alias("seq", "body"))
    rows = found.select(
        "file", "seq", F.get(tokens(F.col("body")), F.lit(0)).alias("function"), F.regexp_extract("body", r'FUNCTION_VERSION\s+"([^"]*)"', 1).alias("version"),
        F.explode(tokens(F.get(bodies(F.col("body"), "DEF_CHARACTERISTIC"), F.lit(0)))).alias("label"),
    )
    return rows.groupBy("file", "label").agg(F.max(F.struct("seq", "function", "version")).alias("b")).select("file", "label", "b.function", "b.version")


def function_counts(texts: DataFrame) -> DataFrame:
    """(file, blocks): how many function blocks a descriptor has, 0 too."""
    return texts.select("file", F.size(bodies(stripped(F.coalesce("text", F.lit(""))), "FUNCTION")).alias("blocks"))


def value_count(kind: Column, matrix_dim: Column, number: Column, axes: Column) -> Column:
    """How many elements a characteristic holds."""
    n = lambda i: F.coalesce(F.get(axes, F.lit(i))["points"], F.lit(1))
    block = F.when(F.size(matrix_dim) > 0, F.aggregate(matrix_dim, F.lit(1), lambda a, d: a * d)).otherwise(F.coalesce(number, F.lit(1)))
    return F.when(kind == "VAL_BLK", block).when(kind == "CURVE", n(0)).when(kind == "MAP", n(0) * n(1)).otherwise(F.lit(1))
