"""Pages, value tables, pairing of files and applying of values: operators over small ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scan
from .rows import split_maps
from .sequence import ordered, runs

# A page header: a function's name and its version (digits and points, a semicolon, a number) in one of three frames.
NAME, VERSION = r"([A-Za-z]\w*)", r"([\d.]+\s*;\s*\d+)"
HEADERS = [rf"FC\s*:\s*{NAME}\s*/\s*{VERSION}", rf"\[\s*{NAME}\s+{VERSION}\s*\]", rf"^\s*{NAME}\s+{VERSION}\b"]
TABLE = r"(?i)^\s*Table\s+(\d+)\b"


def page_headers(lines: DataFrame) -> DataFrame:
    """(doc_id, page, name, version): the first header among a page's lines, in a line the first frame of ``HEADERS``; name
    in lower case, version without spaces."""
    read = F.coalesce(*[F.when(F.col("line").rlike(h), F.struct(F.lower(F.regexp_extract("line", h, 1)).alias("name"), F.regexp_replace(F.regexp_extract("line", h, 2), r"\s+", "").alias("version"))) for h in HEADERS])
    found = lines.withColumn("read", read).where("read is not null").groupBy("doc_id", "page").agg(F.min_by("read", "line_no").alias("read"))
    return found.select("doc_id", "page", "read.name", "read.version")


def function_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, name, version, first_page, last_page, text): pages under one header, carried on over pages without
    one; a header that comes back opens another block. Pages before the first header are left out."""
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"]), "\n").alias("text"))
    own = ordered(["doc_id"], ["page"])
    carried = pages.join(page_headers(lines), ["doc_id", "page"], "left").withColumn("id", F.last(F.when(F.col("name").isNotNull(), F.struct("name", "version")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    known = carried.where("id is not null").withColumn("before", F.lag("id").over(own))
    block = known.withColumn("block", runs(F.col("before").isNull() | (F.col("before") != F.col("id")), ["doc_id"], ["page"]))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    return block.groupBy("doc_id", "block", "id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), body.alias("text")).select("doc_id", "block", "id.name", "id.version", "first_page", "last_page", "text")


def value_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, table_id, label, x, y, val, axes): blocks that open with ``Table N`` and name a label of class C, T, M or CA.

    A line that begins with X, Y or VAL gives that series' numbers, lines after it go on until another begins. ``axes`` are
    the heads that the block's text has. Where no line gave a series, the points and, row by row, the cells
    of a map that is printed in pieces (lines ``Y/X``) count, without one the heads' breakpoints.
    """
    key, order = ["doc_id"], ["line_no"]
    marked = lines.withColumn("opens", F.col("line").rlike(TABLE)).withColumn("block", runs(F.coalesce(F.col("opens"), F.lit(False)), key, order))
    words = F.split(F.trim("line"), r"[\s,;|:]+")
    label = F.get(F.filter(words, lambda w: w.rlike(tx.LABEL)), F.lit(0))
    series = F.upper(F.nullif(F.regexp_extract("line", r"(?i)^\s*(X|Y|VAL)\b", 1), F.lit("")))
    apart = F.col("line").rlike(r"\]\s*\[\s*\d+\s*\]") | (F.upper(F.trim("line")) == "Y/X")  # an axis' head, a printed map
    rows = marked.withColumns({"label": label, "starts": F.when(F.col("opens") | label.isNotNull() | apart, F.lit("")).otherwise(series)})
    own = Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.withColumn("series", F.last("starts", ignorenulls=True).over(own))
    numbers = F.when(F.col("series") != "", tx.numbers(F.regexp_replace("line", r"(?i)^\s*(X|Y|VAL)\b", "")))
    gathered = lambda name: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("series") == name, F.struct("line_no", numbers.alias("v"))))), lambda p: p["v"]))
    found = keyed.groupBy("doc_id", "block").agg(
        F.max(F.when(F.col("opens"), F.regexp_extract("line", TABLE, 1))).alias("table_id"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("line_no"))).alias("label"),
        gathered("X").alias("x"), gathered("Y").alias("y"), gathered("VAL").alias("val"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"]), "\n").alias("_body"),
    )
    told = found.where("table_id is not null and label is not null").withColumn("axes", tx.axes(F.col("_body"))).drop("_body")
    size = lambda axis: F.get(F.filter("axes", lambda a: a["axis"] == axis), F.lit(0))["size"]
    key = F.struct("doc_id", "block").alias("table_key")
    printed = marked.join(told.select("doc_id", "block", size("X").alias("x_size"), size("Y").alias("y_size")), ["doc_id", "block"]).where("y_size > 0")
    maps = split_maps(printed.select(key, "x_size", "y_size", "line_no", "line")).select("table_key.doc_id", "table_key.block", F.col("x").alias("_x"), F.col("y").alias("_y"), F.flatten("z").alias("_val"))
    joined = told.join(maps, ["doc_id", "block"], "left")
    points = lambda axis: F.get(F.filter("axes", lambda a: a["axis"] == axis), F.lit(0))["breakpoints"] if axis != "VAL" else F.lit(None)
    filled = {c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"_{c}", points(c.upper()), c)).alias(c) for c in ("x", "y", "val")}
    return joined.select("doc_id", "table_id", "label", *filled.values(), "axes")


def budget_chunks(lines: DataFrame, budget: int, overlap: int) -> DataFrame:
    """(block_id, chunk, first_line, last_line): lines gathered until the tokens exceed ``budget``; each next chunk begins
    ``overlap`` lines before the end of the last. A block is one function's text and one task's work."""

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_no")
        cost = part["line"].str.len().floordiv(4).clip(lower=1).tolist()
        numbers, out, at = part["line_no"].tolist(), [], 0
        while at < len(cost):
            end, used = at, 0
            while end < len(cost) and (end == at or used + cost[end] <= budget):
                used += cost[end]
                end += 1
            out.append((part["block_id"].iloc[0], len(out), numbers[at], numbers[end - 1]))
            if end == len(cost):
                break
            at = max(at + 1, end - overlap)
        return pd.DataFrame(out, columns=["block_id", "chunk", "first_line", "last_line"])

    return lines.groupBy("block_id").applyInPandas(gather, "block_id long, chunk int, first_line int, last_line int")


def paired_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_name, right_name, how): by equal stem in any case; what is left by place in name order if both sides have as
    many. ``left`` and ``right`` have (name); they are uploads, a handful."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    a, b = left.select(F.col("name").alias("left_name"), stem.alias("stem")), right.select(F.col("name").alias("right_name"), stem.alias("stem"))
    same = a.join(b, "stem").select("left_name", "right_name", F.lit("stem").alias("how"))
    rest_a, rest_b = a.join(b, "stem", "left_anti"), b.join(a, "stem", "left_anti")
    place = lambda df, c: df.select(c, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c)).alias("n"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("m"))
    zipped = place(rest_a, "left_name").join(place(rest_b, "right_name"), ["n", "m"]).select("left_name", "right_name", F.lit("place").alias("how"))
    return same.unionByName(zipped)


def applied_values(values: DataFrame, destination: DataFrame) -> DataFrame:
    """(label, status, new_vals): the first value of each label fitted to the destination's count and compared as exact
    text: updated, unchanged, no_value or missing. ``values`` is (seq, label, value), ``destination`` (label, vals)."""
    first = values.groupBy("label").agg(F.min_by("value", "seq").alias("value"))
    joined = first.join(destination.select("label", "vals"), "label", "left")
    new = tx.fitted(tx.explicit_values(F.coalesce("value", F.lit(""))), F.size("vals"))
    status = F.when(F.col("vals").isNull(), "missing").when(F.size("new_vals") == 0, "no_value").when(F.col("new_vals") == F.col("vals"), "unchanged").otherwise("updated")
    return joined.withColumn("new_vals", F.when(F.col("vals").isNotNull(), new)).select("label", status.alias("status"), "new_vals")


def backfilled(records: DataFrame, documents: DataFrame, reach: int = 5000) -> DataFrame:
    """``records(doc_id, label, values)`` whose values are null get those found within ``reach`` characters after the
    label's first mention in ``documents(doc_id, text)``."""
    joined = records.join(documents, "doc_id", "left")
    at = F.expr("instr(text, label)")
    window = F.when(at > 0, F.substring("text", at + F.length("label"), F.lit(reach)))
    return joined.select("doc_id", "label", F.coalesce("values", tx.start_value(window)["values"]).alias("values"), F.col("values").isNull().alias("was_empty"))


def open_records(lines: DataFrame, key: Sequence[str], order: Sequence[str], opens: Column, closes: Column, skips: Column, **sizes: int | None) -> DataFrame:
    """``lines`` that belong to a record, with ``record``: the order (a struct) of the line that opened it.

    A record is open from a line that ``opens`` one, over pages, until the next one that does or one that ``closes`` it;
    a line that does both opens. Lines that close or that are to be skipped (and don't open) belong to no record, but
    what is skipped leaves it open. Null conditions don't hold. The lines of a key of any size are many tasks' work.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    here = F.struct(*order)
    event = F.when(yes(opens), F.struct(here.alias("record"), F.lit(True).alias("open"))).when(yes(closes), F.struct(here.alias("record"), F.lit(False).alias("open")))
    marked = lines.withColumns({"_event": event, "_skip": yes(skips) & ~yes(opens)})
    held = scan.Ordered(marked, key, order, **sizes).with_running({"_state": scan.last(F.col("_event"))}).frame()
    return held.where(yes(F.col("_state.open")) & ~F.col("_skip")).withColumn("record", F.col("_state.record")).drop("_event", "_skip", "_state")


def continued(rows: DataFrame) -> DataFrame:
    """Rows of one record as one: (record_id, label, value, unit, context); the first value of each field that is not
    null by ``seq``, the contexts joined in order without repeats."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    context = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "context"))), lambda p: p["context"])), " | ")
    return rows.groupBy("record_id").agg(first("label"), first("value"), first("unit"), context.alias("context"))


def merged_axes(rows: DataFrame) -> DataFrame:
    """(record_id, axes): the axes of all rows (record_id, seq, axes array<struct<axis, signal, unit, size, breakpoints>>) of a
    record, each once; each field is the first by ``seq`` that is not null. Axes stand by name."""
    fields = ["signal", "unit", "size", "breakpoints"]
    each = rows.select("record_id", "seq", F.explode("axes").alias("a")).select("record_id", "seq", "a.*")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
    one = each.groupBy("record_id", "axis").agg(*first)
    return one.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("axis", *fields))).alias("axes"))
