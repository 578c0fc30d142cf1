"""Comparison of texts that may be numbers, and of lists of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REL_TOL, ABS_TOL = 1e-4, 1e-6
NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def as_number(text: Column) -> Column:
    """The text as double, null unless it is a plain decimal number (no type suffix, no digit separators)."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def numbers_equal(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap <= ABS_TOL) | (gap <= REL_TOL * F.greatest(F.abs(a), F.abs(b)))


def texts_equal(a: Column, b: Column) -> Column:
    """Trimmed texts are equal, or both numbers within tolerance; two nulls are equal, one is not."""
    x, y = as_number(a), as_number(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.trim(a) == F.trim(b)) | F.coalesce(numbers_equal(x, y), F.lit(False)))


def lists_equal(a: Column, b: Column) -> Column:
    """Same size and every pair of texts equal."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: texts_equal(p["a"], p["b"])), F.lit(False))


def all_numbers(texts: Column) -> Column:
    """The list as doubles if every text is a number, else null."""
    return F.when((F.size(texts) > 0) & F.forall(texts, lambda t: as_number(t).isNotNull()), F.transform(texts, as_number))


def only_numbers(texts: Column) -> Column:
    """The numbers among the texts."""
    return F.filter(F.transform(texts, as_number), lambda v: v.isNotNull())
