"""Interpolation, resampling and packing on arrays, as expressions within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The range of each integer type.
INT_RANGES = {
    "UBYTE": (0, 255),
    "SBYTE": (-128, 127),
    "UWORD": (0, 65535),
    "SWORD": (-32768, 32767),
    "ULONG": (0, 4294967295),
    "SLONG": (-2147483648, 2147483647),
}


def rounded(value: Column, places: int) -> Column:
    """A double at so many places by its product with 10^places, halves away from zero. A zero keeps the sign of what was
    rounded; NaN, the infinite and what overflows stay as they are."""
    scale = F.lit(10.0**places)
    size = F.abs(value) * scale
    whole = F.floor(size).cast("double")
    near = F.when(size < 2.0**52, whole + F.when(size - whole >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(size) / scale
    return F.when(F.isnan(near) | (near == float("inf")) | (value == 0), value).when(value < 0, -near).otherwise(near)


def repaired(x: Column, v: Column) -> Column:
    """array<struct<x, v>> sorted by x, of equal x the first kept."""
    points = F.array_sort(F.transform(x, lambda a, i: F.struct(a.cast("double").alias("x"), i.alias("i"), F.get(v, i).cast("double").alias("v"))))

    def keep(done: Column, p: Column) -> Column:
        last = F.slice(done, F.greatest(F.size(done), F.lit(1)), 1)
        return F.when(F.exists(last, lambda e: e["x"] == p["x"]), done).otherwise(F.concat(done, F.array(F.struct(p["x"].alias("x"), p["v"].alias("v")))))

    return F.aggregate(points, F.expr("cast(array() as array<struct<x: double, v: double>>)"), keep)


def interpolated(points: Column, at: Column) -> Column:
    """The curve through ``points`` (array<struct<x, v>>, x ascending) at each of ``at``: linear inside, beyond the
    ends along the end's slope. No points: zeros; one: its value."""
    n = F.size(points)

    def value(q: Column) -> Column:
        k = F.greatest(F.lit(0), F.least(n - 2, F.size(F.filter(points, lambda p: p["x"] <= q)) - 1))
        a, b = F.get(points, k), F.get(points, k + 1)
        return F.when(n == 0, F.lit(0.0)).when(n == 1, F.get(points, F.lit(0))["v"]).otherwise(a["v"] + (q - a["x"]) * (b["v"] - a["v"]) / (b["x"] - a["x"]))

    return F.transform(at, value)


def positions(n: Column) -> Column:
    """0.0 to n - 1 as doubles; empty for 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i.cast("double"))).otherwise(F.array().cast("array<double>"))


def resampled(values: Column, n: Column) -> Column:
    """``values`` stretched over ``n`` places: the first and last stay, those between are interpolated by index."""
    m = F.size(values)
    spread = F.transform(values, lambda v, i: F.struct((i * (n - 1) / F.greatest(m - 1, F.lit(1))).cast("double").alias("x"), v.cast("double").alias("v")))
    return interpolated(spread, positions(n))


def nearest_indices(n: Column, m: Column) -> Column:
    """For each of ``m`` places the index among ``n``: i * (n - 1) / (m - 1), halves to even."""
    return F.transform(positions(m), lambda i: F.least(n - 1, F.greatest(F.lit(0), F.rint(i * (n - 1) / F.greatest(m - 1, F.lit(1))).cast("int"))))


def label_indices(source: Column, target: Column) -> Column:
    """For each target label the first equal source label's index, else the nearest by place."""
    by_place = nearest_indices(F.size(source), F.size(target))
    return F.transform(target, lambda t, i: F.when(F.array_contains(source, t), (F.array_position(source, t) - 1).cast("int")).otherwise(F.get(by_place, i)))


def packed(value: Column, kind: str) -> Column:
    """The integer that is stored: rounded half to even and held to the type's range; no number stores 0."""
    low, high = INT_RANGES[kind]
    return F.coalesce(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.rint(value))), F.lit(0.0)).cast("long")


def direction(values: Column) -> Column:
    """increasing, decreasing or none; the first two also allow equal neighbours."""
    steps = F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: b - a)
    return F.when(F.forall(steps, lambda d: d >= 0), "increasing").when(F.forall(steps, lambda d: d <= 0), "decreasing").otherwise("none")


def reshaped(flat: Column, nx: int, ny: int) -> Column:
    """ny rows of nx values, row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda r: F.slice(flat, (r * nx + 1).cast("int"), nx))


def transposed(rows: Column) -> Column:
    """A map's columns as rows; short rows end in nulls."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.when(width <= 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, i.cast("int")))))
