"""Tables in a total order, as many files: each file holds a range of the order, and a manifest tells where it begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS, MANIFEST = "rows", "manifest"
#: What marks a text file as UTF-8 for spreadsheets; it stands before the first column's name.
BYTE_MARK = "\ufeff"


def write_sorted(rows: DataFrame, order: Sequence[str], path: str, *, files: int | None = None) -> None:
    """Write ``rows`` by ``order`` (nulls first) to ``path/rows``, and ``path/manifest``: (file, first_row, n_rows).

    Rows are cut by ranges of the order and sorted within them, so no task sorts more than a range, and files stand in
    order by name. Rows of equal order stay in one file: an order should tell rows apart where many are alike.
    """
    parts = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{path}/{ROWS}")
    counts = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{ROWS}").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    counts.select("file", F.coalesce(before, F.lit(0)).alias("first_row"), "n_rows").coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """The rows with ``row``, their place in the order from 0: their file's first row and their place in it. Nothing is sorted."""
    table = spark.read.parquet(f"{path}/{ROWS}")
    placed = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    first = spark.read.parquet(f"{path}/{MANIFEST}").select(F.col("file").alias("_file"), "first_row")
    return placed.join(F.broadcast(first), "_file").select(*table.columns, (F.col("first_row") + F.col("_index")).alias("row"))


def write_csv(rows: DataFrame, order: Sequence[str], path: str, *, files: int | None = None, leave: Sequence[str] = ()) -> None:
    """``rows`` by ``order`` as CSV files with a heading and a byte mark each, without the columns ``leave``; lists and
    structs as JSON, nulls empty."""
    parts = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shown = [(c, kind) for c, kind in rows.dtypes if c not in leave]
    flat = [F.to_json(f"`{c}`") if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in shown]
    named = [value.alias((BYTE_MARK if n == 0 else "") + c) for n, (value, (c, _)) in enumerate(zip(flat, shown, strict=True))]
    ordered.select(*named).write.csv(path, header=True, escape='"', emptyValue="")
