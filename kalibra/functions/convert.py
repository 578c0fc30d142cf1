"""Conversion between stored and physical values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import interpolated

NO_INTERPOLATION = ("TAB_VERB", "TAB_NOINTP")


def rational(coeffs: Column) -> Column:
    """Whether the six coefficients are those of a straight line that is inverted: a = d = f = 0, b not."""
    c = lambda i: F.get(coeffs, F.lit(i))
    return F.coalesce((c(0) == 0) & (c(3) == 0) & (c(5) == 0) & (c(1) != 0), F.lit(False))


def physical(raw: Column, kind: Column, coeffs: Column, linear: Column, tab_kind: Column, pairs: Column, default: Column) -> Column:
    """struct<num, txt>: the physical number, or the text that a table gives; what no rule covers stays raw."""
    c, l = (lambda i: F.get(coeffs, F.lit(i))), (lambda i: F.get(linear, F.lit(i)))
    number = lambda v: F.struct(v.alias("num"), F.lit(None).cast("string").alias("txt"))
    hit = F.get(F.filter(pairs, lambda p: p["raw"].cast("long") == raw.cast("long")), F.lit(0))
    entry = F.struct(hit["num"].alias("num"), F.when(hit["num"].isNull(), hit["txt"]).alias("txt"))
    missed = F.when(default.isNotNull(), F.struct(F.lit(None).cast("double").alias("num"), default.alias("txt"))).otherwise(number(raw))
    points = F.array_sort(F.transform(pairs, lambda p: F.struct(p["raw"].alias("x"), p["num"].alias("v"))))
    held = F.least(F.greatest(raw, F.element_at(points, 1)["x"]), F.element_at(points, -1)["x"])
    known = pairs.isNotNull() & (F.size(pairs) > 0)
    return (
        F.when((kind == "LINEAR") & (F.size(linear) == 2), number(l(0) * raw + l(1)))
        .when((kind == "RAT_FUNC") & rational(coeffs), number((raw * c(4) - c(2)) / c(1)))
        .when(kind.isin(*NO_INTERPOLATION) & known & tab_kind.isin(*NO_INTERPOLATION), F.when(hit.isNotNull(), entry).otherwise(missed))
        .when((kind == "TAB_INTP") & known & (tab_kind == "TAB_INTP"), number(F.get(interpolated(points, F.array(held)), F.lit(0))))
        .otherwise(number(raw))
    )


def stored(num: Column, txt: Column, kind: Column, coeffs: Column, linear: Column, pairs: Column) -> Column:
    """The raw value of a physical one: the inverse of ``physical``; a table of names gives the first entry of equal text or
    number, one that interpolates the nearest, of equally near ones the first; what no entry answers stays as it is."""
    c, l = (lambda i: F.get(coeffs, F.lit(i))), (lambda i: F.get(linear, F.lit(i)))
    entry = F.get(F.filter(pairs, lambda p: F.when(txt.isNotNull(), p["txt"] == txt).otherwise(p["num"] == num)), F.lit(0))["raw"]
    near = F.array_min(F.transform(F.filter(pairs, lambda p: p["num"].isNotNull()), lambda p, i: F.struct(F.abs(p["num"] - num).alias("gap"), i.alias("place"), p["raw"].alias("raw"))))["raw"]
    return (
        F.when((kind == "LINEAR") & (F.size(linear) == 2), F.when(l(0) != 0, (num - l(1)) / l(0)).otherwise(num))
        .when((kind == "RAT_FUNC") & rational(coeffs) & (c(4) != 0), (num * c(1) + c(2)) / c(4))
        .when(kind.isin(*NO_INTERPOLATION), F.coalesce(entry, num))
        .when(kind == "TAB_INTP", F.coalesce(near, num))
        .otherwise(num)
    )
