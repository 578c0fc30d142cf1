"""Tables from people: columns under many names, grouped sheets, keyed collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import filled


def canonical(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = (), instead: Mapping[str, str] | None = None) -> DataFrame:
    """Columns under the names of ``aliases``; the first alias present counts, names compare without case, spaces and
    marks; a column that is absent is that of ``instead`` (such as context: description), else empty text. Raises where a
    required one is absent."""
    plain = lambda name: "".join(c for c in name.lower() if c.isalnum())
    have = {plain(c): c for c in reversed(df.columns)}
    found = {name: next((have[plain(a)] for a in (name, *others) if plain(a) in have), None) for name, others in aliases.items()}
    for name, other in (instead or {}).items():
        found[name] = found[name] or found[other]
    if missing := [name for name in required if found[name] is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c else F.lit("")).alias(name) for name, c in found.items()])


def grouped(rows: DataFrame, label: str, function: str, order: str, key: Sequence[str] = ()) -> DataFrame:
    """(``key``, label, function, seq) of grouped sheets: header rows (*** ... ***) and blanks go, the function is carried
    down over empty cells and NOT FOUND, repeated pairs keep their first row. A sheet, told apart by ``key``, is ordered in
    one task; without ``key`` all rows are one sheet."""
    name = F.trim(F.col(function))
    carried = filled(F.when((name != "") & (name != "NOT FOUND"), name), list(key), [order])
    kept = rows.withColumn("_function", carried).where((F.trim(label) != "") & ~F.col(label).rlike(r"^\s*\*\*\*"))
    return kept.groupBy(*key, F.trim(label).alias("label"), F.col("_function").alias("function")).agg(F.min(order).alias("seq"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables' rows by key, those of ``new`` instead of ``old``'s."""
    names = [c for c in old.columns if c != key]
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*names), "_n").alias("b")).select(key, "b.*")


def where_all(df: DataFrame, equal: Mapping[str, object]) -> DataFrame:
    """Rows that equal every given value; pushed to the scan."""
    condition: Column = F.lit(True)
    for name, value in equal.items():
        condition = condition & (F.col(name) == F.lit(value))
    return df.where(condition)
