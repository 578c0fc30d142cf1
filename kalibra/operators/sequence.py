"""Operators over ordered rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def filled(value: Column, key: Sequence[str], order: Sequence[str]) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0))


def runs(starts: Column, key: Sequence[str], order: Sequence[str]) -> Column:
    """The number of the run a row is in: a row where ``starts`` holds opens one."""
    return F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0))


def islands(rows: DataFrame, key: Sequence[str], number: str, most: int = 1_000_000) -> DataFrame:
    """Runs of consecutive integers: (key, first, last).

    Rows are dealt to as many parts as hold about ``most`` of them each, so that a task's rows don't grow with the table:
    by key and number, where equal rows become one, then by key, as a later grouping by ``key`` needs them.
    """
    known = rows.select(*key, number)
    parts = max(known.count() // most + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = known.repartition(parts, *key, number).distinct().repartition(parts, *key)
    run = F.col(number) - F.row_number().over(ordered(key, [number]))
    return dealt.withColumn("_run", run).groupBy(*key, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def ranges_text(rows: DataFrame, key: Sequence[str], number: str, most: int = 1_000_000) -> DataFrame:
    """Per key its integers as text such as ``1-3, 5``, null of none; ``most`` as in ``islands``."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct("first", one.alias("text"))))
    return islands(rows, key, number, most).groupBy(*key).agg(F.nullif(F.array_join(F.transform(parts, lambda p: p["text"]), ", "), F.lit("")).alias("ranges"))


def numbered(rows: DataFrame, key: Sequence[str], order: str, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``number``, from 1 by the integer ``order`` within the key, and ``first``, the key's smallest ``order``.

    A key may hold most rows: the range of ``order`` is cut into ``buckets`` equal parts, rows are counted by key and part,
    and only rows of one key and part are ordered together. Null keys are a key; rows of null ``order`` are left out. Equal
    ``order`` within a key is numbered in any order.
    """
    known = rows.where(F.col(order).isNotNull())
    low, high = known.agg(F.min(order), F.max(order)).first()
    width = ((high or 0) - (low or 0)) // buckets + 1
    cut = known.withColumn("_b", F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)))
    of_key = Window.partitionBy(*key)
    before = F.sum("n").over(of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counted = cut.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("m"))
    names = [F.col(c).alias(f"_k{n}") for n, c in enumerate(key)]
    offsets = counted.select(*names, F.col("_b").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.min("m").over(of_key).alias("first"))
    same = F.col("_b") == F.col("_p")
    for n, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{n}"))
    own = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(order))
    return cut.join(offsets, same).select(*rows.columns, (F.col("_before") + own).alias("number"), "first")


def lines(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per line: (id, line_no from 0, line)."""
    return documents.select(id_col, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))


def joined_lines(rows: DataFrame, key: str, no: str, line: str, wraps: str) -> DataFrame:
    """Lines whose predecessor matches ``wraps`` are appended to it, the match taken away: (key, start_no, line)."""
    before = F.lag(line).over(ordered([key], [no]))
    parts = F.sort_array(F.collect_list(F.struct(no, F.regexp_replace(line, wraps, "").alias("cut"), F.col(line).alias("whole"))))
    text = F.concat(F.array_join(F.transform(F.slice(F.col("_p"), 1, F.greatest(F.size("_p") - 1, F.lit(0))), lambda p: p["cut"]), ""), F.element_at("_p", -1)["whole"])
    return (
        rows.withColumn("_before", before).withColumn("_run", runs(F.col("_before").isNull() | ~F.col("_before").rlike(wraps), [key], [no]))
        .groupBy(key, "_run").agg(parts.alias("_p")).select(key, F.get("_p", F.lit(0))[no].alias("start_no"), text.alias("line"))
    )
