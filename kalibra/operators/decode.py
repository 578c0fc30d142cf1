"""Descriptors and memory images joined to physical values, and values back to bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert
from ..sources import a2l, hexfile


def _conversions(texts: DataFrame) -> DataFrame:
    tabs = a2l.compu_tabs(texts)
    return a2l.compu_methods(texts).join(tabs, ["file", "tab"], "left")


def _physical(rows: DataFrame) -> DataFrame:
    """``rows`` with raw array and conversion columns gets ``value`` array<struct<num, txt>>."""
    c = F.col
    return rows.withColumn("value", F.transform("raw", lambda r: convert.physical(r, c("conversion_type"), c("coeffs"), c("linear"), c("tab_type"), c("pairs"), c("default_text"))))


def decoded(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(file, label, kind, address, value, cells, unit, nx, ny, x_axis, y_axis, error) of every characteristic; ``cells`` are a
    map's values as rows.

    ``texts`` and ``images`` are (file, text), paired by file. A missing layout is an error row, a missing conversion
    leaves the raw value without unit; axes are read where they are shared points, others are empty.
    """
    data = hexfile.records(images)
    orders, layouts, conversions = a2l.byte_orders(texts), a2l.record_layouts(texts), _conversions(texts)
    rows = a2l.characteristics(texts).join(layouts, ["file", "layout"], "left").join(orders, "file")
    n = lambda i: F.coalesce(F.get("axes", F.lit(i))["points"], F.lit(1))
    sized = rows.withColumns({"count": a2l.value_count(F.col("kind"), F.col("matrix_dim"), F.col("number"), F.col("axes")), "nx": n(0), "ny": n(1)})
    reads = sized.where("value_type is not null").select("file", F.concat(F.lit("c:"), "label").alias("read_id"), "address", F.col("value_type").alias("kind"), "count", "little")
    points = a2l.axis_points(texts).join(layouts.select("file", "layout", "axis_type"), ["file", "layout"]).join(orders, "file")
    axis_reads = points.select("file", F.concat(F.lit("a:"), "axis").alias("read_id"), "address", F.col("axis_type").alias("kind"), F.col("points").alias("count"), "little")
    raw = hexfile.typed(reads.unionByName(axis_reads), data).select("file", "read_id", "raw")

    axis_values = _physical(
        points.withColumn("read_id", F.concat(F.lit("a:"), "axis")).join(raw, ["file", "read_id"], "left").join(conversions, ["file", "conversion"], "left")
    ).select("file", F.col("axis").alias("ref"), "value")
    used = sized.select("file", "label", F.posexplode("axes").alias("pos", "axis")).where("axis.attribute = 'COM_AXIS'").select("file", "label", "pos", "axis.ref")
    read_axes = used.join(axis_values, ["file", "ref"]).groupBy("file", "label").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("read_axes"))

    found = sized.withColumn("read_id", F.concat(F.lit("c:"), "label")).join(raw, ["file", "read_id"], "left").join(conversions, ["file", "conversion"], "left")
    axis = lambda i: F.coalesce(F.try_element_at("read_axes", F.lit(i)), F.array().cast("array<struct<num: double, txt: string>>"))
    error = F.when(F.col("value_type").isNull(), "no_record_layout").when(F.col("raw").isNull(), "missing_bytes")
    return _physical(found).join(read_axes, ["file", "label"], "left").select(
        "file", "label", "kind", "address", "value", F.when(F.col("kind") == "MAP", map_rows(F.col("value"), F.col("nx"), F.col("ny"))).alias("cells"), F.coalesce("unit", F.lit("")).alias("unit"), "nx", "ny", axis(0).alias("x_axis"), axis(1).alias("y_axis"), error.alias("error")
    )


def map_rows(value: Column, nx: Column, ny: Column) -> Column:
    """A map's values as ny rows of nx, row by row in every index mode."""
    return F.transform(F.sequence(F.lit(0), F.greatest(ny, F.lit(1)) - 1), lambda r: F.slice(value, r * nx + 1, F.greatest(nx, F.lit(0))))


def packed(rows: DataFrame) -> DataFrame:
    """(file, at, byte, seq) of ``rows(file, seq, address, raw, kind, little)``: integers rounded half to even and held to
    the type's range, floats as they are; what is no number is 0. 64-bit integers pass through doubles."""

    def one(values: np.ndarray, k: str, le: bool) -> bytes:
        kind_of = np.dtype(("<" if le else ">") + hexfile.TYPES[k])
        numbers = np.asarray(values, dtype=np.float64)
        if kind_of.kind == "f":
            with np.errstate(over="ignore"):
                return numbers.astype(kind_of).tobytes()
        low, high = np.iinfo(kind_of).min, np.iinfo(kind_of).max
        held = [0 if v != v else low if v <= low else high if v >= high else round(v) for v in numbers.tolist()]
        return np.array(held, dtype=kind_of).tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [one(*x) for x in zip(part["raw"], part["kind"], part["little"], strict=True)]
            yield part[["file", "seq", "address"]].assign(bytes=pd.Series(done, index=part.index, dtype=object))

    numbers = F.transform("raw", lambda v: F.coalesce(v, F.lit(0.0)))
    given = rows.where(F.col("raw").isNotNull()).select("file", F.col("seq").cast("long").alias("seq"), "address", numbers.alias("raw"), hexfile.known_type(F.col("kind")).alias("kind"), "little")
    done = given.mapInPandas(run, "file string, seq long, address long, bytes binary")
    each = done.select("file", "seq", "address", F.posexplode(F.regexp_extract_all(F.hex("bytes"), F.lit(".."), F.lit(0))).alias("k", "byte"))
    return each.select("file", (F.col("address") + F.col("k")).alias("at"), "byte", "seq")


def _bytes(rows: DataFrame) -> DataFrame:
    """(file, at, byte, seq) of ``rows`` with value, conversion columns, value_type, little, address and seq."""
    c = F.col
    raw = F.transform("value", lambda v: convert.stored(v["num"], v["txt"], c("conversion_type"), c("coeffs"), c("linear"), c("pairs")))
    return packed(rows.select("file", "seq", "address", raw.alias("raw"), c("value_type").alias("kind"), "little"))


def _described(updates: DataFrame, texts: DataFrame) -> DataFrame:
    return updates.join(a2l.characteristics(texts), ["file", "label"]).join(a2l.record_layouts(texts), ["file", "layout"])


def patches(updates: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, at, byte, seq) for ``updates(file, label, seq, value array<struct<num, txt>>)``, all data types.

    Values are converted back, rounded half to even and held to an integer type's range; labels without a characteristic
    or a layout give nothing, ``patch_events`` says why.
    """
    rows = _described(updates, texts).join(a2l.byte_orders(texts), "file").join(_conversions(texts), ["file", "conversion"], "left")
    return _bytes(rows)


def _shared_axes(updates: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, ref, label, seq, value): of each axis that labels share the points that the first label by ``seq`` brings."""
    axes = _described(updates, texts).where("kind in ('CURVE', 'MAP')").select("file", "label", "seq", "new_axes", F.posexplode("axes").alias("pos", "axis"))
    brought = axes.where("axis.attribute = 'COM_AXIS' and axis.ref is not null").select("file", F.col("axis.ref").alias("ref"), "label", "seq", F.get("new_axes", F.col("pos")).alias("value"))
    return brought.where(F.size("value") > 0).groupBy("file", "ref").agg(F.min(F.struct("seq", "label", "value")).alias("b")).select("file", "ref", "b.*")


def axis_patches(updates: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, at, byte, seq) of the shared axes of curves and maps: ``updates(file, label, seq, new_axes)`` holds a label's
    axes as array<array<struct<num, txt>>>, by place. An axis is written once, no more points than it has."""
    points = a2l.axis_points(texts).join(a2l.record_layouts(texts).select("file", "layout", "axis_type"), ["file", "layout"], "left")
    rows = _shared_axes(updates, texts).join(points.withColumnRenamed("axis", "ref"), ["file", "ref"]).join(a2l.byte_orders(texts), "file").join(_conversions(texts), ["file", "conversion"], "left")
    cut = F.slice("value", F.lit(1), F.greatest(F.col("points"), F.lit(0)))
    return _bytes(rows.withColumns({"value": cut, "value_type": F.coalesce("axis_type", F.lit("UWORD"))}))


def flattened(rows: Column, kind: Column, nx: Column, ny: Column) -> Column:
    """A map's rows as ny times nx values, missing cells as empty texts (which store 0); of other kinds the rows joined.

    ``rows`` is array<array<struct<num, txt>>>."""
    empty = F.struct(F.lit(None).cast("double").alias("num"), F.lit("").alias("txt"))
    n = lambda v: F.sequence(F.lit(0), F.greatest(v, F.lit(1)) - 1)
    full = F.flatten(F.transform(n(ny), lambda r: F.transform(n(nx), lambda c: F.coalesce(F.get(F.get(rows, r), c), empty))))
    return F.when(kind == "MAP", full).otherwise(F.flatten(rows))


# What the report says of a label that was or was not patched.
PATCH_REASONS = {
    "patched": "patched from CDFX",
    "axis_points": "no A2L characteristic (label exists as AXIS_PTS)",
    "unknown": "no A2L characteristic (label not found in A2L)",
    "no_layout": "missing record layout",
}


def patch_events(updates: DataFrame, texts: DataFrame) -> DataFrame:
    """(file, label, kind, source, action, stage, reason) of each of ``updates(file, label, ...)``: kind is patched,
    axis_points or unknown (no characteristic of that name), or no_layout. Without values nothing is said."""
    known = a2l.characteristics(texts).select("file", "label", "layout")
    layouts = a2l.record_layouts(texts).select("file", "layout", F.lit(True).alias("_laid"))
    axes = a2l.axis_points(texts).select("file", F.col("axis").alias("label"), F.lit(True).alias("_axis"))
    rows = updates.join(known, ["file", "label"], "left").join(layouts, ["file", "layout"], "left").join(axes, ["file", "label"], "left")
    kind = F.when(F.col("layout").isNull(), F.when(F.col("_axis"), "axis_points").otherwise("unknown")).when(F.col("_laid").isNull(), "no_layout").when(F.size("value") > 0, "patched")
    reason = F.create_map(*[F.lit(x) for kv in PATCH_REASONS.items() for x in kv])
    action = F.when(F.col("kind") == "patched", "patched").otherwise("skipped")
    return rows.withColumn("kind", kind).where("kind is not null").select("file", "label", "kind", F.lit("hex_patch").alias("source"), action.alias("action"), F.lit("hex_patch").alias("stage"), F.try_element_at(reason, F.col("kind")).alias("reason"))
