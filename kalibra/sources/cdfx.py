"""Parameter-set XML: one row per instance in the document's order, in a normal form; and rendering back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE = r"(?s)<(?:\w+:)?SW-INSTANCE(?:\s[^>]*)?>.*?</(?:\w+:)?SW-INSTANCE>"

# Label suffixes of each kind, tried in this order, case as written.
SUFFIXES = [("SCALAR", ("_C", "_CW", "_c")), ("ARRAY", ("_CA",)), ("MAP", ("_MAP", "_M")), ("CURVE", ("_T", "_CUR", "_Cur"))]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def kind_of(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, ends in reversed(SUFFIXES):
        hit = F.lit(False)
        for e in ends:
            hit = hit | label.endswith(e)
        out = F.when(hit, kind).otherwise(out)
    return out


def well_formed(fragment: Column) -> Column:
    """Whether an instance reads as XML."""
    parsed = F.from_xml(fragment, "struct<_broken: string>", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "rowTag": "SW-INSTANCE"})
    return fragment.isNotNull() & parsed["_broken"].isNull()


def fragments(texts: DataFrame) -> DataFrame:
    """(file, pos, fragment, plain, label): the instances of ``texts(file, text)`` as they stand, and names without spaces
    around. An instance that is not well-formed gives no row; ``broken`` lists them."""
    rows = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(INSTANCE), F.lit(0))).alias("pos", "fragment"))
    bare = F.regexp_replace("fragment", r"<(/?)\w+:", "<$1")
    plain = F.when(well_formed(bare), bare)
    named = rows.select("file", "pos", "fragment", plain.alias("plain"), F.trim(F.xpath_string(plain, F.lit("/SW-INSTANCE/SHORT-NAME"))).alias("label"))
    return named.where("label <> ''")


def broken(texts: DataFrame) -> DataFrame:
    """(file, pos, fragment) of the instances that are not well-formed."""
    rows = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(INSTANCE), F.lit(0))).alias("pos", "fragment"))
    return rows.where(~well_formed(F.regexp_replace("fragment", r"<(/?)\w+:", "<$1")))


def _inner(block: Column, path: str) -> Column:
    return F.xpath(block, F.lit(f"{path}/*[self::V or self::VT]/text()"))


def instances(texts: DataFrame) -> DataFrame:
    """(file, pos, label, fragment, kind, unit, vals, rows array<struct<label, vals, is_text>>, x_axis, y_axis,
    numbers, texts, sized): the last of
    equal labels of a file; labels of no known kind have a null kind."""
    p = F.col("plain")
    body = "/SW-INSTANCE/SW-VALUE-CONT/SW-VALUES-PHYS"
    groups = F.regexp_extract_all(p, F.lit(r"(?s)<VG(?:\s[^>]*)?>.*?</VG>"), F.lit(0))
    row = lambda g: F.struct(
        F.trim(F.coalesce(F.get(F.xpath(g, F.lit("/VG/LABEL/text()")), F.lit(0)), F.lit(""))).alias("label"), F.xpath(g, F.lit("/VG/*[self::V or self::VT]/text()")).alias("vals"), (F.size(F.xpath(g, F.lit("/VG/VT/text()"))) > 0).alias("is_text")
    )
    axes = F.regexp_extract_all(p, F.lit(r"(?s)<SW-AXIS-CONT(?:\s[^>]*)?>.*?</SW-AXIS-CONT>"), F.lit(0))
    axis = lambda i: F.coalesce(_inner(F.get(axes, F.lit(i)), "/SW-AXIS-CONT/SW-VALUES-PHYS"), F.array().cast("array<string>"))
    filled = lambda tag: F.filter(F.transform(F.xpath(p, F.lit(f"{body}/{tag}/text()")), lambda v: F.trim(v)), lambda v: v != "")
    rows = fragments(texts).select(
        "file", "pos", "label", "fragment", kind_of(F.col("label")).alias("kind"), F.xpath_string(p, F.lit("/SW-INSTANCE/SW-VALUE-CONT/UNIT-DISPLAY-NAME")).alias("unit"),
        _inner(p, body).alias("vals"), F.transform(groups, row).alias("rows"), axis(0).alias("x_axis"), axis(1).alias("y_axis"),
        filled("V").alias("numbers"), filled("VT").alias("texts"), (F.trim(F.xpath_string(p, F.lit("/SW-INSTANCE/SW-VALUE-CONT/SW-ARRAYSIZE/V"))) != "").alias("sized"),
    )
    names = [c for c in rows.columns if c not in ("file", "label", "pos")]
    return rows.groupBy("file", "label").agg(F.max_by(F.struct(*names), "pos").alias("b"), F.max("pos").alias("pos")).select("file", "pos", "label", "b.*")


def valued(found: DataFrame) -> DataFrame:
    """``instances`` as a comparison of sets reads them: those that have the values their kind asks for, ``vals`` being these.

    A scalar has one value, its first number or else its first text; an array tells its size, and has its texts or
    else its numbers; a curve has its numbers or else its texts. Scalars without value and arrays without size are left
    out; maps and labels of no known kind are as they are. Blank values are none.
    """
    numbers, texts = F.col("numbers"), F.col("texts")
    either = lambda first, second: F.when(F.size(first) > 0, first).otherwise(second)
    kind = F.col("kind")
    vals = F.when(kind == "SCALAR", F.slice(either(numbers, texts), 1, 1)).when(kind == "ARRAY", either(texts, numbers)).when(kind == "CURVE", either(numbers, texts)).otherwise(F.col("vals"))
    lacks = ((kind == "SCALAR") & (F.size(numbers) + F.size(texts) == 0)) | ((kind == "ARRAY") & ~F.col("sized"))
    return found.withColumn("vals", vals).where(~F.coalesce(lacks, F.lit(False)))


def number_text(value: Column) -> Column:
    """Decimal text that reads back as the same number: plain from 1e-4 up to 1e16, beyond with an exponent of two digits."""
    usual = value.cast("string")
    fixed = F.regexp_replace(value.cast("decimal(38, 20)").cast("string"), r"0+$", "")
    long = F.regexp_replace(F.regexp_replace(value.cast("decimal(38, 10)").cast("string"), r"0+$", ""), r"\.$", ".0")
    size = F.abs(value)
    power = F.regexp_extract(usual, r"E-?(\d+)$", 1)
    sign = F.when(F.contains(usual, F.lit("E-")), "e-").otherwise("e+")
    scientific = F.concat(F.regexp_replace(F.regexp_extract(usual, r"^(.*)E", 1), r"\.0$", ""), sign, F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    return (
        F.when((size >= 1e-4) & (size < 1e-3), fixed).when((size >= 1e7) & (size < 1e16), long).when(F.contains(usual, F.lit("E")), scientific).otherwise(usual)
    )


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def elements(values: Column, is_text: Column) -> Column:
    """V elements for numbers, VT for texts."""
    return F.array_join(F.transform(values, lambda v: F.when(is_text, F.concat(F.lit("<VT>"), escaped(v), F.lit("</VT>"))).otherwise(F.concat(F.lit("<V>"), v, F.lit("</V>")))), "")


def rendered_instance(label: Column, category: Column, unit: Column, vals: Column, is_text: Column, rows: Column, x_axis: Column, y_axis: Column) -> Column:
    """One instance as text; ``rows`` (array<struct<label, vals>>) null or empty where the values are flat."""
    group = lambda r: F.concat(F.lit("<VG><LABEL>"), escaped(r["label"]), F.lit("</LABEL>"), elements(r["vals"], F.lit(False)), F.lit("</VG>"))
    flat = F.coalesce(F.size(rows), F.lit(0)) <= 0
    body = F.when(flat, elements(vals, is_text)).otherwise(F.array_join(F.transform(rows, group), ""))
    axis = lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(F.lit("<SW-AXIS-CONT><SW-VALUES-PHYS>"), elements(a, F.lit(False)), F.lit("</SW-VALUES-PHYS></SW-AXIS-CONT>"))).otherwise("")
    return F.concat(
        F.lit("<SW-INSTANCE><SHORT-NAME>"), escaped(label), F.lit("</SHORT-NAME><CATEGORY>"), category, F.lit("</CATEGORY><SW-VALUE-CONT><UNIT-DISPLAY-NAME>"), escaped(F.coalesce(unit, F.lit(""))),
        F.lit("</UNIT-DISPLAY-NAME><SW-VALUES-PHYS>"), body, F.lit("</SW-VALUES-PHYS></SW-VALUE-CONT><SW-AXIS-CONTS>"), axis(x_axis), axis(y_axis), F.lit("</SW-AXIS-CONTS></SW-INSTANCE>"),
    )


def documents(pieces: DataFrame, doctype: str | None = None) -> DataFrame:
    """(file, text) of ``pieces(file, pos, fragment)`` in their order, in a document of their own, with ``doctype`` as its
    DOCTYPE declaration if given."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fragment"))), lambda p: p["fragment"]), "\n")
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n' + (f"<!DOCTYPE {doctype}>\n" if doctype else "") + '<MSRSW><SW-INSTANCE-SPEC><SW-INSTANCE-TREE>\n', "\n</SW-INSTANCE-TREE></SW-INSTANCE-SPEC></MSRSW>\n"
    return pieces.groupBy("file").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def merged(destination: DataFrame, updates: DataFrame) -> DataFrame:
    """The destination's fragments, each replaced by that of ``updates(label, fragment)`` where there is one; places stay."""
    new = updates.select("label", F.col("fragment").alias("new"))
    return documents(fragments(destination).join(new, "label", "left").select("file", "pos", F.coalesce("new", "fragment").alias("fragment")))


def subset(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, text): the files with only the instances whose label is in ``labels(label)``, in their order."""
    return documents(fragments(texts).join(labels.select("label").distinct(), "label", "left_semi").select("file", "pos", "fragment"))
