"""Value tables joined to the records that refer to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import scan


def best_tables(tables: DataFrame, key: str) -> DataFrame:
    """``tables(doc_id, seq, table_id, label, x, y, val)`` reduced to the one with most numbers of each document and
    ``key`` (table_id or label), of equally rich ones the first by ``seq``. Tables without the key are left out."""
    numbers = F.greatest(F.size("x"), F.lit(0)) + F.greatest(F.size("y"), F.lit(0)) + F.greatest(F.size("val"), F.lit(0))
    names = [c for c in tables.columns if c not in ("doc_id", key)]
    known = tables.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return known.groupBy("doc_id", key).agg(F.max_by(F.struct(*names), F.struct(numbers, -F.col("seq"))).alias("t")).select("doc_id", key, "t.*")


def linked(records: DataFrame, tables: DataFrame) -> DataFrame:
    """``records(doc_id, label, table_ref, context)`` with ``x``, ``y`` and ``val`` of the table they mean, and ``how``.

    A reference by number takes the document's table of that number, or none. Else a context that names the label in
    brackets or says to see a table takes the table of that label.
    """
    by_id = best_tables(tables, "table_id").select("doc_id", F.col("table_id").alias("table_ref"), F.struct("x", "y", "val").alias("of_id"))
    by_label = best_tables(tables, "label").select("doc_id", "label", F.struct("x", "y", "val").alias("of_label"))
    named = F.expr("locate(concat('[', label, ']'), regexp_replace(context, '\\\\[\\\\s*([^\\\\]]*?)\\\\s*\\\\]', '[$1]')) > 0")
    wants = F.when(F.col("table_ref").isNotNull(), "number").when(F.coalesce(named | F.col("context").rlike(r"(?i)see\s+table"), F.lit(False)), "label")
    joined = records.withColumn("wants", wants).join(by_id, ["doc_id", "table_ref"], "left").join(by_label, ["doc_id", "label"], "left")
    found = F.when(F.col("wants") == "number", F.col("of_id")).when(F.col("wants") == "label", F.col("of_label"))
    return joined.withColumn("t", found).select(*records.columns, "t.x", "t.y", "t.val", F.when(F.col("t").isNotNull(), F.col("wants")).alias("how"))


def label_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, block, label, text): the lines of ``lines(doc_id, block, line_no, line)`` that belong to each label of a
    table block, after the block's title. A line belongs to the label that it begins with, else to the last one named so
    or in brackets above it."""
    begins, bracket = r"^\s*([A-Za-z]\w*_(?:CA|C|T|M))\b", r"\[\s*([A-Za-z]\w*_(?:CA|C|T|M))\s*\]"
    own = Window.partitionBy("doc_id", "block").orderBy("line_no")
    label = F.coalesce(tx.part(F.col("line"), begins, 1), tx.part(F.col("line"), bracket, 1))
    marked = lines.withColumn("label", F.last(label, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    titled = marked.withColumn("title", F.first(F.when(F.col("line").rlike(r"(?i)^\s*Table\s+\d+\b"), F.rtrim("line"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.rtrim("line").alias("line")))), lambda p: p["line"]), "\n")
    joined = titled.where("label is not null").groupBy("doc_id", "block", "label").agg(F.min("title").alias("title"), body.alias("body"))
    return joined.select("doc_id", "block", "label", F.concat_ws("\n", "title", "body").alias("text"))


def enriched(records: DataFrame, spans: DataFrame, lines: DataFrame, *, bucket: int = 64) -> DataFrame:
    """``records(doc_id, record_id, context)`` whose contexts go on with the texts of their ``spans(doc_id, record_id,
    first_line, last_line)`` in ``lines(doc_id, line_no, line)``, in the order of the spans, a line each.

    A text that the context holds already, or that another span of the record has said, is not added; nor is one without
    words. Lines meet spans by the bucket of ``bucket`` lines that they lie in: an equality, so that no document's lines go
    to every span and no side is broadcast. Record ids are unique in their document; spans without lines add nothing.
    """
    covered = F.explode(F.sequence(F.floor(F.col("first_line") / bucket), F.floor(F.col("last_line") / bucket)))
    dealt = spans.where("first_line <= last_line").distinct().select(F.col("doc_id").alias("_doc"), "record_id", "first_line", "last_line", covered.alias("_bucket"))
    placed = lines.select("doc_id", "line_no", "line", F.floor(F.col("line_no") / bucket).alias("_at"))
    met = placed.join(dealt, (F.col("doc_id") == F.col("_doc")) & (F.col("_at") == F.col("_bucket")) & F.col("line_no").between(F.col("first_line"), F.col("last_line")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.rtrim("line").alias("line")))), lambda p: p["line"]), "\n")
    texts = met.groupBy("doc_id", "record_id", "first_line", "last_line").agg(F.trim(body, F.lit(" \n\t\r")).alias("text")).where("text <> ''")
    said = F.transform(F.sort_array(F.collect_list(F.struct("first_line", "last_line", "text"))), lambda p: p["text"])
    of_record = texts.groupBy(F.col("doc_id").alias("_doc"), F.col("record_id").alias("_record")).agg(F.array_distinct(said).alias("_texts"))
    joined = records.join(of_record, (F.col("doc_id") == F.col("_doc")) & (F.col("record_id") == F.col("_record")), "left")
    context = F.coalesce("context", F.lit(""))
    fresh = F.filter(F.coalesce("_texts", F.array().cast("array<string>")), lambda t: ~F.contains(context, t))
    whole = F.array_join(F.filter(F.concat(F.array(F.rtrim(context)), fresh), lambda t: t != ""), "\n")
    return joined.withColumn("context", F.when(F.size(fresh) > 0, whole).otherwise(F.col("context"))).select(*records.columns)


def marks_nearby(lines: DataFrame, key: Sequence[str], order: Sequence[str], mark: Column, name: str, *, back: int = 3, ahead: int = 1, **sizes: int | None) -> DataFrame:
    """``lines`` with ``name``: the first ``mark`` (a table's number, say) that is not null from ``back`` lines before to
    ``ahead`` lines after each of them."""
    return scan.framed(lines.withColumn("_mark", mark), key, order, lambda w: F.first("_mark", ignorenulls=True).over(w), name, back, ahead, **sizes).drop("_mark")


def loosely_linked(records: DataFrame, tables: DataFrame) -> DataFrame:
    """``records(doc_id, label, table_ref)`` with ``table_seq`` of the table of the same document that they mean, and ``how``.

    Asked in turn: the table of that number, one whose number has the same digits, the table of that label, one whose label
    ends in the record's (its part after the last point), in any case. Of several the first by ``seq`` answers. An ending is
    found by equality with the endings of the tables' labels, which are as many as those have letters.
    """
    first = lambda key, value, how: tables.select("doc_id", value.alias(key), "seq").where(F.col(key) != "").groupBy("doc_id", key).agg(F.min("seq").alias(how))
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), "")
    low = F.lower("label")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.length(low))))
    keyed = records.withColumns({"_id": F.coalesce("table_ref", F.lit("")), "_digits": digits(F.coalesce("table_ref", F.lit(""))), "_end": F.lower(F.substring_index("label", ".", -1))})
    joined = (
        keyed.join(first("_id", F.col("table_id"), "number"), ["doc_id", "_id"], "left").join(first("_digits", digits(F.col("table_id")), "digits"), ["doc_id", "_digits"], "left")
        .join(first("label", F.col("label"), "whole"), ["doc_id", "label"], "left").join(first("_end", ends, "ending"), ["doc_id", "_end"], "left")
    )
    tiers = {"number": "number", "digits": "digits", "whole": "label", "ending": "ending"}
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for c, name in tiers.items()])
    return joined.select(*records.columns, F.coalesce(*tiers).alias("table_seq"), how.alias("how"))
