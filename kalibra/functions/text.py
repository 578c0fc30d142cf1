"""Reading values, units, limits and axes out of descriptive text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import notation
from .compare import as_number

# Words and marks of the documents' notation.
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
LABEL_PREFIXES = "ti fac rat pwr u vol i cur st b pct val num tq n".split()
CLASSES = {"C": "VALUE", "T": "CURVE", "M": "MAP", "CA": "VAL_BLK"}
#: What a unit or a prefix implies: units that it takes, prefixes that it takes, whether both must hold, bounds, name.
IMPLIED = [
    (["%", "percent"], ["pct", "rat"], False, 0, 100, "implicit_percent_ratio"),
    (["", "-", "dimensionless"], ["fac"], True, 0, 1, "implicit_factor"),
    ([], ["ti"], False, 0, None, "implicit_non_negative"),
    ([], ["b"], False, 0, 1, "implicit_boolean"),
]
#: module_[instance.][prefix]name_suffix
LABEL = rf"(?i)^([a-z0-9]+)_(?:(\w+)\.)?({'|'.join(LABEL_PREFIXES)})?([a-z0-9]+)_({'|'.join(sorted(CLASSES, key=len, reverse=True))})$"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where the pattern or the group is absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: n.cast("double"))


def unit(text: Column) -> Column:
    """A missing or dashed unit is dimensionless."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(bare.isin("", "-", "−", "--"), "dimensionless").otherwise(bare)


VALUE = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("unit", T.StringType()), T.StructField("for_all", T.BooleanType())])
LIMITS = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()), T.StructField("kind", T.StringType())])
RANGE = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()), T.StructField("unit", T.StringType())])
AXES = T.ArrayType(
    T.StructType([T.StructField("axis", T.StringType()), T.StructField("signal", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("breakpoints", T.ArrayType(T.DoubleType()))])
)


def read_by(reader: Callable[[str | None], Any], kind: T.DataType) -> Callable[[Column], Column]:
    """``reader``, a function of one text, as a function of a column, in Arrow batches."""

    @F.arrow_udf(kind)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([reader(t) for t in texts.to_pylist()], to_arrow_type(kind))

    return read


def read_together(**readers: tuple[Callable[[str | None], Any], T.StructType | T.ArrayType]) -> Callable[[Column], Column]:
    """A struct of what several readers find in a text, which goes to Python and becomes tokens once for all of them."""
    kind = T.StructType([T.StructField(name, t) for name, (_, t) in readers.items()])

    @F.arrow_udf(kind)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = list(to_arrow_type(kind))
        own = [reader for reader, _ in readers.values()]
        for texts in batches:
            found = [[reader(t) for reader in own] for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([row[k] for row in found], field.type) for k, field in enumerate(fields)], fields=fields)

    return read


#: struct<values, unit, for_all>: what follows the marker; else the last numbers that carry a unit, outside axes. A
#: reference to a table gives none. Lists with a unit come before single values, the last one counts; after a marker
#: numbers without unit do as well.
start_value = read_by(notation.start_value, VALUE)
#: struct<lower, upper, kind> by the first of ``notation.BOUNDS`` that the text has.
limits = read_by(notation.limits, LIMITS)
#: struct<lower, upper, unit> of the second range a...b, of the first if there is one alone.
physical_range = read_by(notation.physical_range, RANGE)
#: array<struct<axis, signal, unit, size, breakpoints>>; an axis' breakpoints stand before the next axis, no more than its size.
axes = read_by(notation.axes, AXES)
#: struct<limits, start_value, axes, physical_range>, as the four above.
phrases = read_together(limits=(notation.limits, LIMITS), start_value=(notation.start_value, VALUE), axes=(notation.axes, AXES), physical_range=(notation.physical_range, RANGE))
#: The number of the table that a text refers to, after its start marker if there is one.
table_reference = read_by(notation.table_reference, T.StringType())
before_marker = read_by(notation.before_marker, T.StringType())
is_marked = read_by(notation.is_marked, T.BooleanType())
marked_word = read_by(notation.marked_word, T.StringType())
ended_value = read_by(notation.ended_value, T.StructType([T.StructField("value", T.StringType()), T.StructField("unit", T.StringType())]))


def label_parts(label: Column) -> Column:
    """struct<module, instance, prefix, name, suffix, object_class>; nulls for what is no label."""
    names = ["module", "instance", "prefix", "name", "suffix"]
    classes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return F.struct(*[part(label, LABEL, n).alias(name) for n, name in enumerate(names, 1)], F.try_element_at(classes, F.upper(part(label, LABEL, 5))).alias("object_class"))


def explicit_values(text: Column) -> Column:
    """The values of a cell: without ``(all)``, split at commas, semicolons or bars, else at spaces if all are numbers."""
    bare = F.trim(F.regexp_replace(text, r"(?i)\(all\)", ""))
    marks, spaces = F.filter(F.transform(F.split(bare, r"[,;|]"), lambda v: F.trim(v)), lambda v: v != ""), F.split(bare, r"\s+")
    return F.when(bare == "", F.array().cast("array<string>")).when(bare.rlike(r"[,;|]"), marks).when(F.forall(spaces, lambda v: as_number(v).isNotNull()), spaces).otherwise(F.array(bare))


def fitted(values: Column, n: Column) -> Column:
    """``n`` values: one is repeated, too few end in the last, too many are cut; none stay none."""
    short = F.concat(values, F.array_repeat(F.try_element_at(values, F.lit(-1)), F.greatest(n - F.size(values), F.lit(0))))
    return F.when(F.size(values) > 0, F.slice(short, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(values)


def salvaged_array(text: Column, kind: str) -> Column:
    """The first [...] of a reply, fences and talk around it ignored, parsed as ``kind``; null if it is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), kind)


def implied_limits(prefix: Column, unit_text: Column) -> Column:
    """struct<lower, upper, kind> by the first of ``IMPLIED`` that a label's prefix or unit meets; else unbounded."""
    p, u = F.lower(F.coalesce(prefix, F.lit(""))), F.lower(F.trim(F.coalesce(unit_text, F.lit(""))))
    made = lambda low, high, kind: F.struct(F.lit(low).cast("double").alias("lower"), F.lit(high).cast("double").alias("upper"), F.lit(kind).alias("kind"))
    met = lambda units, prefixes, both: (u.isin(*units) & p.isin(*prefixes)) if both else (u.isin(*units) | p.isin(*prefixes))
    return F.coalesce(*[F.when(met(units, prefixes, both), made(low, high, kind)) for units, prefixes, both, low, high, kind in IMPLIED], made(None, None, "unbounded"))


# Misreadings of scanned documents and what they stand for; glyphs without a meaning.
REPAIRS = [("E1M_", "ElM_"), (r"E\]M_", "ElM_"), (r"\bEMO(\d)", "EM0$1"), (r"([A-Za-z0-9])_c\b", "$1_C"), ("−", "-"), (r"\(cid:\d+\)", "")]


def repaired_text(text: Column, repairs: list[tuple[str, str]] = REPAIRS) -> Column:
    out = text
    for pattern, new in repairs:
        out = F.regexp_replace(out, pattern, new)
    return out


def calibration_row(label: Column, text: Column) -> Column:
    """One label's row of a document: its parts and class, the context before the start value, value, unit, limits, axes
    and the table that its value refers to, named after the start marker if there is one."""
    parts = label_parts(label)
    context = before_marker(text)
    value = start_value(text)
    found = F.coalesce(limits(context), implied_limits(parts["prefix"], value["unit"]))
    return F.struct(
        parts["object_class"].alias("object_class"), context.alias("context"), value["values"].alias("values"), value["unit"].alias("unit"), value["for_all"].alias("for_all"),
        found["lower"].alias("lower"), found["upper"].alias("upper"), found["kind"].alias("limit_kind"), axes(text).alias("axes"), table_reference(text).alias("table_ref"),
    )


def key_count(body: Column) -> Column:
    """How many keys a JSON text holds at all depths; lists are not entered, 0 for what is no object.

    One pass over the text's own marks, at any depth and length: without escapes and strings what is left of it are
    brackets, colons and plain values, and each colon outside lists stands behind a key.
    """
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), '"[^"]*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]:]"), F.lit(0))
    start = F.struct(F.lit(0).alias("lists"), F.lit(0).cast("long").alias("n"))
    step = lambda s, m: F.struct(
        (s["lists"] + F.when(m == "[", 1).when(m == "]", -1).otherwise(0)).alias("lists"), (s["n"] + F.when((m == ":") & (s["lists"] == 0), 1).otherwise(0)).cast("long").alias("n")
    )
    return F.when(F.json_object_keys(body).isNotNull(), F.aggregate(marks, start, step)["n"]).otherwise(F.lit(0).cast("long"))


def key_counts(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, n): the keys in the JSON texts ``body`` of each ``key``, at all depths; null texts take no part."""
    return rows.where(F.col(body).isNotNull()).groupBy(key).agg(F.sum(key_count(F.col(body))).alias("n"))
