"""Updating scalars, arrays, curves and maps of a destination from sources of other dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.compare import all_numbers, as_number, lists_equal, texts_equal
from ..sources import cdfx


def picked(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(values, i))


def array_update(source: Column, size: Column) -> tuple[Column, Column]:
    """(numbers, texts): a numeric source resampled over ``size`` places, else its nearest texts by place."""
    numbers = all_numbers(source)
    return F.when(numbers.isNotNull(), numeric.resampled(numbers, size)), F.when(numbers.isNull(), picked(source, numeric.nearest_indices(F.size(source), size)))


def curve_update(source: Column, source_x: Column, x: Column, size: Column) -> tuple[Column, Column]:
    """As arrays, but where both axes are numeric and fit the values, read at the destination's axis, which stays."""
    z, sx, dx = all_numbers(source), all_numbers(source_x), all_numbers(x)
    fits = (F.size(z) == F.size(sx)) & (F.size(dx) == size)
    by_place, texts = array_update(source, size)
    return F.when(F.coalesce(fits, F.lit(False)), numeric.interpolated(numeric.repaired(sx, z), dx)).otherwise(by_place), texts


def map_update(s: str, d: str) -> Column:
    """struct<cells, x, y>: the source map ``s`` (a column prefix) at the destination ``d``'s dimensions.

    Rows first: at the destination's numeric y, or the row of equal label, or by index; then columns likewise by x.
    Short source rows end in their last value. Axes that are numeric on both sides become the source's, resampled
    by index, while cells are read at the destination's old axis.
    """
    c = lambda p, name: F.col(f"{p}.{name}")
    sx, dx, sy, dy = all_numbers(c(s, "x_axis")), all_numbers(c(d, "x_axis")), all_numbers(c(s, "y_axis")), all_numbers(c(d, "y_axis"))
    raw = F.transform(c(s, "rows"), lambda r: F.filter(F.transform(r["vals"], as_number), lambda v: v.isNotNull()))
    nx = F.array_max(F.transform(raw, F.size))
    rows = F.transform(raw, lambda r: F.concat(r, F.array_repeat(F.coalesce(F.try_element_at(r, F.lit(-1)), F.lit(0.0)), nx - F.size(r))))
    ny, my = F.size(raw), F.size(c(d, "rows"))
    mx = F.size(F.get(c(d, "rows"), F.lit(0))["vals"])
    columns = F.sequence(F.lit(0), nx - 1)
    column = lambda j: F.transform(rows, lambda r: F.get(r, j))
    labels = F.transform(c(d, "rows"), lambda r: r["label"])

    by_y = F.transform(columns, lambda j: numeric.interpolated(numeric.repaired(sy, column(j)), dy))
    by_label = F.transform(columns, lambda j: picked(column(j), numeric.label_indices(c(s, "y_axis"), labels)))
    by_index = F.transform(columns, lambda j: numeric.resampled(column(j), my))
    numeric_y = F.coalesce((F.size(sy) == ny) & (F.size(dy) == my), F.lit(False))
    named_y = F.coalesce((F.size(c(s, "y_axis")) == ny) & (F.size(c(s, "y_axis")) > 0), F.lit(False))
    tall = F.when(numeric_y, by_y).when(named_y, by_label).otherwise(by_index)  # columns of my values
    wide = F.transform(F.sequence(F.lit(0), my - 1), lambda i: F.transform(tall, lambda col: F.get(col, i)))

    numeric_x = F.coalesce((F.size(sx) == nx) & (F.size(dx) == mx), F.lit(False))
    named_x = F.coalesce((F.size(c(s, "x_axis")) == nx) & (F.size(c(d, "x_axis")) == mx), F.lit(False))
    across = lambda r: (
        F.when(numeric_x, numeric.interpolated(numeric.repaired(sx, r), dx))
        .when(named_x, picked(r, numeric.label_indices(c(s, "x_axis"), c(d, "x_axis"))))
        .otherwise(numeric.resampled(r, mx))
    )
    axis = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), numeric.resampled(a, F.size(b)))
    found = F.struct(F.transform(wide, across).alias("cells"), axis(sx, dx).alias("x"), axis(sy, dy).alias("y"))
    return F.when((nx > 0) & (mx > 0) & (my > 0), found)


def updated(sources: list[tuple[str, DataFrame]], destination: DataFrame, *, exact: bool = False) -> DataFrame:
    """Every destination label: (label, kind, pos, source, status, numbers, texts, cells, x, y, fragment).

    ``sources`` are instances in priority order; a label is taken from the first that has it. status is updated, copied
    (nothing changes within tolerance), skipped (its kind or cells can't be read) or attention (in no source).
    ``fragment`` is the updated instance as text. ``exact`` compares texts as they are, and takes every map for changed.
    """
    names = ["kind", "unit", "vals", "rows", "x_axis", "y_axis"]
    stack = None
    for n, (name, df) in enumerate(sources):
        own = df.select("label", F.lit(n).alias("priority"), F.lit(name).alias("source"), F.struct(*names).alias("s"))
        stack = own if stack is None else stack.unionByName(own)
    first = stack.where("s.kind is not null").groupBy("label").agg(F.min_by(F.struct("source", "s"), "priority").alias("b")).select("label", "b.*")
    joined = destination.select("label", "pos", F.struct(*names, "fragment").alias("d")).join(first, "label", "left")

    kind, size = F.col("d.kind"), F.size("d.vals")
    array_n, array_t = array_update(F.col("s.vals"), size)
    curve_n, curve_t = curve_update(F.col("s.vals"), F.col("s.x_axis"), F.col("d.x_axis"), size)
    enum = F.exists("d.rows", lambda r: r["is_text"])
    # An exploded one-element array is a boundary that projections are not merged over: each update is worked out once.
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    worked = once(
        joined,
        numbers=F.when(kind == "ARRAY", array_n).when(kind == "CURVE", curve_n),
        texts=F.when(kind == "SCALAR", F.slice("s.vals", 1, 1)).when(kind == "ARRAY", array_t).when(kind == "CURVE", curve_t),
        m=F.when((kind == "MAP") & ~enum, map_update("s", "d")),
    )
    as_text = lambda a: F.transform(a, cdfx.number_text)
    flat_old, flat_new = F.col("d.vals"), F.coalesce(as_text(F.col("numbers")), F.col("texts"))
    same_map = (
        lists_equal(F.flatten(F.transform("d.rows", lambda r: r["vals"])), as_text(F.flatten("m.cells")))
        & lists_equal(F.col("d.x_axis"), F.coalesce(as_text(F.col("m.x")), F.col("d.x_axis"))) & lists_equal(F.col("d.y_axis"), F.coalesce(as_text(F.col("m.y")), F.col("d.y_axis")))
    )
    same = F.when(kind == "MAP", same_map).when(kind == "SCALAR", texts_equal(F.get(flat_old, F.lit(0)), F.get(F.col("texts"), F.lit(0)))).otherwise(lists_equal(flat_old, flat_new))
    if exact:
        same = F.when(kind == "MAP", F.lit(False)).otherwise(F.coalesce(flat_old == flat_new, F.lit(False)))
    unreadable = kind.isNull() | ((kind == "MAP") & F.col("m").isNull()) | ((kind != "MAP") & ((size == 0) | F.coalesce(F.size("s.vals"), F.lit(0)).eqNullSafe(0)))
    status = F.when(F.col("source").isNull(), "attention").when(unreadable, "skipped").when(same, "copied").otherwise("updated")

    numbers = F.transform("numbers", cdfx.number_text)
    labels = F.transform("d.rows", lambda r, i: F.coalesce(cdfx.number_text(F.get("m.y", i)), r["label"]))
    cells = F.zip_with(labels, F.col("m.cells"), lambda t, v: F.struct(t.alias("label"), v.alias("vals")))
    out = once(worked, status=status, flat=F.coalesce(numbers, "texts"), cell_rows=cells)
    text_cells = F.transform("cell_rows", lambda r: F.struct(r["label"].alias("label"), as_text(r["vals"]).alias("vals")))
    is_text = ~F.coalesce(F.forall("flat", lambda v: as_number(v).isNotNull()), F.lit(False))
    fragment = cdfx.rendered_instance(F.col("label"), kind, F.coalesce("s.unit", "d.unit"), F.col("flat"), is_text, text_cells, F.coalesce(as_text(F.col("m.x")), F.col("d.x_axis")), F.coalesce(as_text(F.col("m.y")), F.col("d.y_axis")))
    return out.select("label", kind.alias("kind"), "pos", "source", "status", "numbers", "texts", F.col("m.cells").alias("cells"), F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.when(F.col("status") == "updated", fragment).alias("fragment"))
