"""Calibration JSON: an object of labels, each with a value (number, text, list or list of lists), unit and axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import as_number
from .cdfx import kind_of


def _list(text: Column) -> Column:
    """A JSON list of plain values as texts."""
    return F.from_json(text, "array<string>")


def entries(texts: DataFrame) -> DataFrame:
    """(file, label, unit, vals array<string>, rows array<array<string>>, axes array<array<double>>) of ``texts(file, text)``.

    An axis is a list, or an object with a list under ``values``.
    """
    labels = texts.select("file", F.explode(F.from_json("text", "map<string, string>")).alias("label", "body"))
    fields = labels.select("file", "label", F.from_json("body", "value string, unit string, axes array<string>").alias("e"))
    value = F.col("e.value")
    nested, listed = F.trim(value).rlike(r"^\[\s*\["), F.trim(value).startswith("[")
    axis = lambda a: F.when(F.trim(a).startswith("["), F.from_json(a, "array<double>")).otherwise(F.from_json(a, "values array<double>")["values"])
    return fields.select(
        "file", "label", F.col("e.unit").alias("unit"),
        F.when(nested, F.array().cast("array<string>")).when(listed, _list(value)).otherwise(F.array(value)).alias("vals"),
        F.when(nested, F.from_json(value, "array<array<string>>")).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
        F.transform(F.coalesce("e.axes", F.array().cast("array<string>")), axis).alias("axes"),
    )


def instances(texts: DataFrame) -> DataFrame:
    """The entries in the form of ``cdfx.instances``, so that they can be a source of updates; a map's cell that is no
    number is 0.0."""
    number = lambda v: F.when(as_number(v).isNotNull(), v).otherwise("0.0")
    row = lambda r, i: F.struct(i.cast("string").alias("label"), F.transform(r, number).alias("vals"), F.lit(False).alias("is_text"))
    axis = lambda i: F.coalesce(F.transform(F.get("axes", F.lit(i)), lambda v: v.cast("string")), F.array().cast("array<string>"))
    return entries(texts).select(
        "file", F.lit(0).alias("pos"), "label", F.lit(None).cast("string").alias("fragment"), kind_of(F.col("label")).alias("kind"), "unit", "vals",
        F.transform("rows", row).alias("rows"), axis(0).alias("x_axis"), axis(1).alias("y_axis"),
    )
